"""Reshape and nested data: flatten a struct / JSON column, explode an array,
pivot and unpivot."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import field_type, ident, idents, require_columns
from .aggregate import metric_column


def infer_json_schema(df: DataFrame, column: str) -> str:
    """DDL of the merged schema of every JSON value in ``column`` (one
    aggregate pass over the column; only the schema text reaches the driver)."""
    row = df.select(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("s")).first()
    return _variant_schema_to_ddl(row["s"] if row and row["s"] else "STRUCT<>")


def _variant_schema_to_ddl(text: str) -> str:
    # variant schemas spell structs OBJECT<...>; the DDL parser wants STRUCT<...>
    return re.sub(r"\bOBJECT<", "STRUCT<", text)


def flatten(
    df: DataFrame,
    column: str,
    prefix: str = "",
    drop_original: bool = False,
    *,
    schema: str | T.StructType | None = None,
) -> DataFrame:
    """Lift the fields of a struct column (or a JSON text column, parsed with
    ``schema`` or an inferred one) to top-level columns ``prefix + field``.
    One level deep; nested structs stay structs."""
    col = ident(column)
    require_columns(df, [col])
    dt = field_type(df, col)
    if isinstance(dt, T.StringType):
        ddl = schema if schema is not None else infer_json_schema(df, col)
        parsed = F.from_json(F.col(col), ddl)
        st = df.select(parsed.alias("_tw_s")).schema["_tw_s"].dataType
        source = parsed
    elif isinstance(dt, T.StructType):
        st, source = dt, F.col(col)
    elif isinstance(dt, T.VariantType):
        ddl = schema if schema is not None else _variant_schema_to_ddl(df.select(F.schema_of_variant_agg(F.col(col)).alias("s")).first()["s"])
        source = F.from_json(F.to_json(F.col(col)), ddl)
        st = df.select(source.alias("_tw_s")).schema["_tw_s"].dataType
    else:
        raise ValueError(f"flatten needs a struct, JSON text or variant column, {col!r} is {dt.simpleString()}")
    new = [prefix + f.name for f in st.fields]
    existing = {c.lower() for c in df.columns if not (drop_original and c.lower() == col.lower())}
    clash = [n for n in new if n.lower() in existing]
    if clash:
        raise ValueError(f"flattened names already exist: {clash}; choose a prefix")
    keep = [F.col(c) for c in df.columns if not (drop_original and c.lower() == col.lower())]
    return df.select(*keep, *[source.getField(f.name).alias(prefix + f.name) for f in st.fields])


def explode(df: DataFrame, column: str, *, position: str | None = None) -> DataFrame:
    """One row per array element in place of the array; a null or empty array
    gives one row with a null element (``explode_outer``).  ``position``
    names an optional column with the element index (0-based)."""
    col = ident(column)
    require_columns(df, [col])
    dt = field_type(df, col)
    if not isinstance(dt, T.ArrayType):
        raise ValueError(f"explode needs an array column, {col!r} is {dt.simpleString()}")
    pos = df.columns.index(next(c for c in df.columns if c.lower() == col.lower()))
    before, after = df.columns[:pos], df.columns[pos + 1 :]
    if position:
        ident(position)
        return df.select(*before, F.posexplode_outer(F.col(col)).alias(ident(position), col), *after)
    return df.select(*before, F.explode_outer(F.col(col)).alias(col), *after)


def pivot(
    df: DataFrame,
    index: Sequence[str],
    columns: str,
    values: Sequence[str],
    agg: str = "first",
    *,
    pivot_values: Sequence | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """``groupBy(index).pivot(columns).agg(...)``.  With one value column the
    new columns are named by the pivot values, with several ``{value}_{column}``.
    Pass ``pivot_values`` to skip the extra job that finds the distinct values
    (Spark caps them at ``spark.sql.pivotMaxValues``)."""
    idx = idents(index, allow_empty=True)
    pc = ident(columns)
    vals = idents(values, what="values")
    require_columns(df, idx + [pc] + vals)
    exprs = [metric_column(df, v, agg, order_by=order_by).alias(v) for v in vals]
    g = df.groupBy(*idx)
    p = g.pivot(pc, list(pivot_values)) if pivot_values is not None else g.pivot(pc)
    return p.agg(*exprs)


def unpivot(
    df: DataFrame,
    index: Sequence[str],
    columns: Sequence[str] | None = None,
    variable_name: str = "variable",
    value_name: str = "value",
) -> DataFrame:
    """Wide to long: one row per (index row, value column).  Value columns are
    cast to one type first: double when all are numeric, else string."""
    idx = idents(index, allow_empty=True)
    require_columns(df, idx)
    cols = idents(columns) if columns else [c for c in df.columns if c.lower() not in {i.lower() for i in idx}]
    require_columns(df, cols)
    types = [field_type(df, c) for c in cols]
    if all(isinstance(t, T.NumericType) for t in types):
        target = "double" if any(not isinstance(t, T.IntegralType) for t in types) else "bigint"
    elif len({t.simpleString() for t in types}) == 1:
        target = types[0].simpleString()
    else:
        target = "string"
    cast = df.select(*idx, *[F.col(c).cast(target).alias(c) for c in cols])
    return cast.unpivot(idx, cols, ident(variable_name), ident(value_name))
