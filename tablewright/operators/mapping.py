"""Explicit projection onto declared target columns.

Each target column is fed by exactly one provider: a source column, a
literal, or an operation over source columns.  The result is one
``select`` in the declared order; a non-nullable target raises inside the
plan (``raise_error``), so a failing job aborts before the sink commits.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import field_type, ident, require_columns
from ..functions.types import MAPPING_TYPE_NAMES, spark_type

# Operation names and how many input columns each takes
# (None = one or more).
OPERATION_ARITY = {
    "concat": None,
    "coalesce": None,
    "add": None,
    "subtract": 2,
    "multiply": None,
    "divide": 2,
    "upper": 1,
    "lower": 1,
    "trim": 1,
    "cast": 1,
}
ON_ZERO = ("null", "error", "ieee")


def validate_mappings(mappings: Sequence[dict]) -> None:
    if not mappings:
        raise ValueError("column mappings must not be empty")
    seen = set()
    for m in mappings:
        extra = set(m) - {"target_column", "source_column", "literal", "operation", "nullable"}
        if extra:
            raise ValueError(f"unknown mapping fields: {sorted(extra)}")
        t = ident(m["target_column"])
        if t.lower() in seen:
            raise ValueError(f"duplicate target column {t!r}")
        seen.add(t.lower())
        providers = [k for k in ("source_column", "literal", "operation") if k in m]
        if len(providers) != 1:
            raise ValueError(f"target column {t!r} needs exactly one of source_column, literal, operation")
        if "literal" in m and m["literal"] is None and m.get("nullable", True) is False:
            raise ValueError(f"target column {t!r} is non-nullable but its literal is null")
        op = m.get("operation")
        if op is not None:
            extra = set(op) - {"type", "columns", "separator", "data_type"}
            if extra:
                raise ValueError(f"unknown operation fields: {sorted(extra)}")
            kind = op.get("type")
            if kind not in OPERATION_ARITY:
                raise ValueError(f"no mapping operation is named {kind!r}")
            cols = op.get("columns") or []
            want = OPERATION_ARITY[kind]
            if (want is None and len(cols) < 1) or (want is not None and len(cols) != want):
                raise ValueError(f"operation {kind!r} takes {want or 'one or more'} columns, got {len(cols)}")
            for c in cols:
                ident(c)
            if (kind == "cast") != ("data_type" in op):
                raise ValueError("data_type is required for cast and allowed only there")
            if kind == "cast" and op["data_type"] not in MAPPING_TYPE_NAMES:
                raise ValueError(f"cast data_type must be one of {MAPPING_TYPE_NAMES}")
            if "separator" in op and kind != "concat":
                raise ValueError("separator applies to concat only")


def required_columns(m: dict) -> list[str]:
    if "source_column" in m:
        return [m["source_column"]]
    if "operation" in m:
        return list(m["operation"]["columns"])
    return []


def _text(c: Column) -> Column:
    return c.cast("string")


def _operation(df: DataFrame, op: dict, on_zero: str) -> Column:
    kind = op["type"]
    cols = [F.col(c) for c in op["columns"]]
    types = [field_type(df, c) for c in op["columns"]]
    if kind == "concat":
        # null when any part is null (concat, not concat_ws)
        sep = F.lit(op.get("separator", ""))
        parts = [_text(cols[0])]
        for c in cols[1:]:
            parts += [sep, _text(c)]
        return F.concat(*parts)
    if kind == "coalesce":
        return F.coalesce(*cols)
    if kind in ("add", "subtract", "multiply", "divide"):
        bad = [c for c, t in zip(op["columns"], types) if not isinstance(t, T.NumericType)]
        if bad:
            raise ValueError(f"operation {kind!r} needs numeric columns, not {bad}; use concat for text")
    if kind == "add":
        return reduce(add, cols)
    if kind == "subtract":
        return cols[0] - cols[1]
    if kind == "multiply":
        return reduce(mul, cols)
    if kind == "divide":
        a, b = cols[0].cast("double"), cols[1].cast("double")
        if on_zero == "error":
            return a / b
        if on_zero == "ieee":
            return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)
        return F.try_divide(a, b)
    if kind == "upper":
        return F.upper(_text(cols[0]))
    if kind == "lower":
        return F.lower(_text(cols[0]))
    if kind == "trim":
        # all leading/trailing whitespace (Spark's trim strips spaces only)
        return F.regexp_replace(_text(cols[0]), r"^\s+|\s+$", "")
    return cols[0].cast(spark_type(op["data_type"]))


def mapping_column(df: DataFrame, m: dict, on_zero: str = "null") -> Column:
    if "source_column" in m:
        expr = F.col(ident(m["source_column"]))
    elif "literal" in m:
        v = m["literal"]
        expr = F.lit(v).cast("string") if v is None else F.lit(v)
    else:
        expr = _operation(df, m["operation"], on_zero)
    t = m["target_column"]
    if m.get("nullable", True) is False:
        expr = F.when(expr.isNull(), F.raise_error(F.lit(f"null in column '{t}', which is mapped as non-nullable"))).otherwise(expr)
    return expr.alias(t)


def map_target(df: DataFrame, mappings: Sequence[dict], *, on_zero: str = "null") -> DataFrame:
    """Project ``df`` onto the declared target columns, in order."""
    if on_zero not in ON_ZERO:
        raise ValueError(f"on_zero must be one of {ON_ZERO}")
    validate_mappings(mappings)
    for m in mappings:
        need = required_columns(m)
        have = {c.lower() for c in df.columns}
        missing = sorted(c for c in need if c.lower() not in have)
        if missing:
            raise ValueError(f"mapping of '{m['target_column']}' reads missing columns {missing}")
    require_columns(df, [c for m in mappings for c in required_columns(m)])
    return df.select(*[mapping_column(df, m, on_zero) for m in mappings])
