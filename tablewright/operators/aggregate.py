"""Group-by aggregation with a closed metric list.

``aggregate`` is one ``groupBy().agg()``: Spark plans a partial aggregate
before the shuffle and a final one after it, so a hot group is pre-reduced on
every map task.  Exact distinct counts and distinct-count sketches are
aggregated apart, as Spark would otherwise keep a sketch for each distinct
value.  ``median`` and ``mode`` keep a group's values in one buffer
there; ``large_groups=True`` takes them from ranked value counts instead
(``ranks``), with the same result.  ``implode`` gives a group's values in
lists of at most ``chunk_rows``, several rows for a large group, and stands
alone.  ``sketch`` stores a mergeable distinct-count sketch, which
``merge_sketches`` joins over loads.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import field_type, ident, idents, require_columns
from ..functions.types import canon
from .ranks import beside, group_chunks, group_median, group_mode
from .setops import union

# Metric names of the typed contract, then the extended set.
CORE_METRICS = ("sum", "min", "max", "mean", "median", "count", "n_unique", "first", "last")
EXTENDED_METRICS = ("std", "var", "product", "any", "all", "null_count", "len", "mode", "skewness", "kurtosis", "approx_n_unique", "sketch", "implode")
RANKED_METRICS = {"median": group_median, "mode": group_mode}
SKETCHES = ("approx_n_unique", "sketch")
CHUNK_ROWS = 10_000
#: log2 of a sketch's registers: a relative standard error of 1.04 / 64.
SKETCH_BITS = 12
METRICS = CORE_METRICS + EXTENDED_METRICS


def metric_column(
    df: DataFrame,
    column: str,
    agg: str,
    *,
    order_by: Sequence[str] | None = None,
    approx_median: bool = False,
    null_sum_as_zero: bool = False,
) -> Column:
    c = F.col(ident(column))
    dt = field_type(df, column)
    if agg not in METRICS:
        raise ValueError(f"Unsupported metric {agg!r}; choose from {METRICS}")
    if isinstance(dt, T.BooleanType) and agg in ("sum", "mean", "median", "std", "var", "product", "skewness", "kurtosis"):
        c = c.cast("long")
    if agg == "sum":
        return F.coalesce(F.sum(c), F.lit(0)) if null_sum_as_zero else F.sum(c)
    if agg == "min":
        return F.min(c)
    if agg == "max":
        return F.max(c)
    if agg == "mean":
        return F.avg(c)
    if agg == "median":
        return F.percentile_approx(c, 0.5, 10000) if approx_median else F.median(c)
    if agg == "count":
        return F.count(c)
    if agg == "n_unique":
        # null counts as one more distinct value
        return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))
    if agg == "approx_n_unique":
        return F.approx_count_distinct(c, 1.04 / 2 ** (SKETCH_BITS / 2)) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))
    if agg == "sketch":
        if not isinstance(dt, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
            c = canon(c, dt)
        return F.hll_sketch_agg(c, SKETCH_BITS)
    if agg in ("first", "last"):
        if not order_by:
            raise ValueError(f"metric {agg!r} needs order_by: a distributed dataset has no input order")
        require_columns(df, order_by)
        # a struct ordering keeps rows whose ordering is null (they sort
        # first); the value itself breaks ties so the pick is deterministic
        ordering = F.struct(*[F.col(ident(o)) for o in order_by], c.alias("_tw_v"))
        pick = F.min_by if agg == "first" else F.max_by
        return pick(F.struct(c.alias("v")), ordering).getField("v")
    if agg == "std":
        return F.stddev_samp(c)
    if agg == "var":
        return F.var_samp(c)
    if agg == "product":
        return F.product(c)
    if agg == "any":
        return F.bool_or(c)
    if agg == "all":
        return F.bool_and(c)
    if agg == "null_count":
        return F.count_if(c.isNull())
    if agg == "len":
        return F.count(F.lit(1))
    if agg == "mode":
        return F.mode(c, deterministic=True)
    if agg == "skewness":
        return F.skewness(c)
    return F.kurtosis(c)


def aggregate(
    df: DataFrame,
    group_by: Sequence[str],
    metrics: Sequence[dict],
    *,
    order_by: Sequence[str] | None = None,
    approx_median: bool = False,
    null_sum_as_zero: bool = False,
    large_groups: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``metrics``: ``[{column, agg, alias?}]``; alias defaults to ``{column}_{agg}``.
    Empty ``group_by`` gives one global row.  ``large_groups``: no buffer holds
    a group's values.  ``implode`` needs ``order_by``, and adds a column
    ``{alias}_chunk``."""
    keys = idents(group_by, allow_empty=True)
    require_columns(df, keys)
    if not metrics:
        raise ValueError("aggregate needs at least one metric")
    exprs, ranked, sketches, order, names = [], [], [], [], set(k.lower() for k in keys)
    distinct = any(m["agg"] == "n_unique" for m in metrics)
    for m in metrics:
        extra = set(m) - {"column", "agg", "alias"}
        if extra:
            raise ValueError(f"unknown metric fields: {sorted(extra)}")
        require_columns(df, [m["column"]])
        alias = ident(m.get("alias") or f"{m['column']}_{m['agg']}")
        if alias.lower() in names:
            raise ValueError(f"duplicate output column {alias!r}")
        names.add(alias.lower())
        if m["agg"] == "implode":
            if len(metrics) > 1 or not order_by:
                raise ValueError("metric 'implode' stands alone and needs order_by")
            if chunk_rows < 1:
                raise ValueError("chunk_rows must be at least 1")
            require_columns(df, order_by)
            return group_chunks(df, keys, m["column"], alias, idents(order_by), chunk_rows)
        order.append(alias)
        if large_groups and m["agg"] in RANKED_METRICS and not (m["agg"] == "median" and approx_median):
            ranked.append((m, alias))
            continue
        (sketches if distinct and m["agg"] in SKETCHES else exprs).append(
            metric_column(
                df, m["column"], m["agg"], order_by=order_by, approx_median=approx_median, null_sum_as_zero=null_sum_as_zero
            ).alias(alias)
        )
    if not ranked and not sketches:
        return df.groupBy(*keys).agg(*exprs) if keys else df.agg(*exprs)
    out = df.groupBy(*keys).agg(*exprs, F.count(F.lit(1)).alias("_tw_rows"))
    if sketches:
        out = beside(out, df.groupBy(*keys).agg(*sketches), keys)
    for m, alias in ranked:
        source = df.withColumn(m["column"], F.col(m["column"]).cast("long")) if m["agg"] == "median" and isinstance(field_type(df, m["column"]), T.BooleanType) else df
        out = beside(out, RANKED_METRICS[m["agg"]](source, keys, m["column"], alias), keys)
    return out.select(*keys, *order)


def merge_sketches(df: DataFrame, group_by: Sequence[str], column: str, *, estimate: str | None = None) -> DataFrame:
    """Sketches of several loads, stored in ``column``, merged by group; with
    ``estimate`` the distinct count of each merged sketch in that column."""
    keys = idents(group_by, allow_empty=True)
    require_columns(df, [*keys, column])
    out = df.groupBy(*keys).agg(F.hll_union_agg(column).alias(column))
    return out.withColumn(ident(estimate), F.hll_sketch_estimate(column)) if estimate else out


def aggregate_multi(
    frames: Sequence[DataFrame],
    union_type: str,
    group_by: Sequence[str],
    metrics: Sequence[dict],
    *,
    align_schema: bool = False,
    **kwargs,
) -> DataFrame:
    """Union several inputs (``union_all`` or distinct ``union``), then aggregate."""
    return aggregate(union(frames, union_type, align_schema=align_schema), group_by, metrics, **kwargs)
