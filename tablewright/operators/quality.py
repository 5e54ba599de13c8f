"""Data-quality steps: schema check, exception extraction, quarantine and
schema-drift handling.

Schema checks compare names (and optionally types) against ``df.schema`` on
the driver: metadata only, no data is read.
"""
from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import field_type, ident
from ..functions.predicates import condition
from ..functions.types import spark_type
from ..sources.sinks import new_scratch_path, observed_rows


def missing_columns(df: DataFrame, expected: Mapping[str, str] | Sequence[str]) -> list[str]:
    have = {c.lower() for c in df.columns}
    return [c for c in expected if c.lower() not in have]


# Which Spark types satisfy each declared type family.
_FAMILIES = {
    "string": (T.StringType,),
    "bigint": (T.IntegralType,),
    "double": (T.FloatType, T.DoubleType),
    "boolean": (T.BooleanType,),
    "date": (T.DateType,),
    "timestamp_ntz": (T.TimestampNTZType, T.TimestampType),
}


def type_mismatches(df: DataFrame, expected: Mapping[str, str]) -> list[str]:
    """Declared type families not met: integer = any integral type, float =
    float or double, decimal = any decimal, datetime = either timestamp."""
    out = []
    for name, tname in expected.items():
        if name.lower() not in {c.lower() for c in df.columns}:
            continue
        want = spark_type(tname)
        got = field_type(df, name)
        ok = isinstance(got, T.DecimalType) if want.startswith("decimal") else isinstance(got, _FAMILIES[want])
        if not ok:
            out.append(f"{name}:{got.simpleString()}!={tname}")
    return out


def schema_validate(
    df: DataFrame,
    schema: Mapping[str, str],
    fail_on_error: bool = True,
    *,
    flag: str | None = None,
    check_types: bool = False,
) -> DataFrame:
    """Check that the expected column names are present.

    Without ``flag``: raise ``ValueError`` (or pass through when
    ``fail_on_error=False``).  With ``flag``: never raise; the column holds
    ``"OK"`` or ``"MISSING:a,b"`` (names in config order).  ``check_types``
    also compares declared types and reports ``TYPE:...``.
    """
    for n in schema:
        ident(n)
    missing = missing_columns(df, schema)
    wrong = type_mismatches(df, schema) if check_types else []
    parts = []
    if missing:
        parts.append("MISSING:" + ",".join(missing))
    if wrong:
        parts.append("TYPE:" + ",".join(wrong))
    detail = ";".join(parts) if parts else "OK"
    if flag:
        return df.withColumn(ident(flag), F.lit(detail))
    if parts and fail_on_error:
        raise ValueError(f"Schema validation failed: {detail}")
    return df


def exceptions(
    frames: Sequence[DataFrame],
    cond: dict | Column,
    output_mode: str = "exceptions_only",
    *,
    flag: str | None = None,
) -> DataFrame:
    """Union the inputs by name (absent columns null), then keep the rows
    matching the condition (``exceptions_only``) or the rows where it is false
    (any other mode).  Rows where the condition is null are in neither.
    With ``flag`` keep all rows and write the condition to that column."""
    if not frames:
        raise ValueError("exception-extract needs at least one input")
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    c = condition(cond, u) if isinstance(cond, dict) else cond
    if flag:
        return u.withColumn(ident(flag), c)
    return u.filter(c) if output_mode == "exceptions_only" else u.filter(~c)


def error_predicate(df: DataFrame, error_column: str) -> Column:
    """True for a bad row: boolean column true, or text/other not null and
    not ``""`` / ``"OK"``."""
    c = F.col(ident(error_column))
    dt = field_type(df, error_column)
    if isinstance(dt, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    text = c.cast("string")
    return c.isNotNull() & ~text.isin("", "OK")


def quarantine(
    df: DataFrame,
    error_column: str,
    include_valid_output: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Split into ``(valid, rejected)`` by the error column.  Persisting the
    rejected rows is the caller's write (see ``sources.sinks.write_quarantine``);
    with ``include_valid_output=False`` the valid output is empty."""
    bad = error_predicate(df, error_column)
    rejected = df.filter(bad)
    valid = df.filter(~bad) if include_valid_output else df.limit(0)
    return valid, rejected


def quarantine_once(df: DataFrame, error_column: str) -> tuple[DataFrame, DataFrame, dict[str, int | None]]:
    """``(valid, rejected, counts)`` from one run of ``df``'s plan: rows are
    tagged, written once in a folder for each tag of the shared scratch folder,
    and both sides read their own; the counts come from that write."""
    spark, path = df.sparkSession, new_scratch_path(df.sparkSession, "quarantine")
    tag = "_tw_rejected"
    obs = Observation(f"tw_quarantine_{uuid.uuid4().hex[:8]}")
    tagged = df.withColumn(tag, error_predicate(df, error_column))
    counted = tagged.observe(obs, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col(tag).cast("long")), F.lit(0)).alias("rejected"))
    counted.write.partitionBy(tag).parquet(path)
    rows = observed_rows(obs)
    counts = {"rejected": None, "valid": None} if rows is None else {"rejected": int(obs.get["rejected"]), "valid": rows - int(obs.get["rejected"])}
    # the schema is given, so a side without rows reads as empty
    staged = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(tag, T.BooleanType())])).parquet(path)
    return staged.where(~F.col(tag)).drop(tag), staged.where(F.col(tag)).drop(tag), counts


DRIFT_MODES = ("add_missing_columns", "drop_extra_columns", "fail")


def handle_drift(df: DataFrame, mode: str, expected_schema: Mapping[str, str], default_value=None) -> DataFrame:
    """add_missing_columns: add each absent expected column as ``default_value``
    cast to its declared type; drop_extra_columns: keep only expected columns
    (in expected order, absent ones are not invented); fail: raise when any
    name is missing or extra."""
    if mode not in DRIFT_MODES:
        raise ValueError(f"drift mode must be one of {DRIFT_MODES}, not {mode!r}")
    for n in expected_schema:
        ident(n)
    have = {c.lower(): c for c in df.columns}
    exp = {n.lower(): n for n in expected_schema}
    missing = [n for n in expected_schema if n.lower() not in have]
    extra = [c for c in df.columns if c.lower() not in exp]
    if mode == "fail":
        if missing or extra:
            raise ValueError(f"schema drift: missing {missing}, extra {extra}")
        return df
    if mode == "add_missing_columns":
        return df.withColumns({n: F.lit(default_value).cast(spark_type(expected_schema[n])) for n in missing})
    return df.select(*[have[n.lower()] for n in expected_schema if n.lower() in have])
