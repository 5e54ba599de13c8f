"""Exact median and mode of groups of any size.

Spark's ``median`` and ``mode`` hold a map of a group's values in one buffer.
Here the values of all groups are counted (a plain aggregate, pre-reduced on
every map task), and for the median the counts are added up along the values
over range partitions (``running``), so a group that holds every row, all
different, is spread over all tasks with flat memory.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running


def value_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``keys, _tw_v, _tw_n``: values that are not null, and their rows."""
    return df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_tw_v")).agg(F.count("*").alias("_tw_n"))


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of ``right`` beside those of ``left`` by equal keys, null
    equal to null; without keys both have one row, ``right`` or none."""
    if not keys:
        both = left.unionByName(right, allowMissingColumns=True)
        return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])
    names = {k: f"_tw_k{i}" for i, k in enumerate(keys)}
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right.withColumnsRenamed(names), same, "left").drop(*names.values())


def group_median(df: DataFrame, keys: Sequence[str], column: str, alias: str) -> DataFrame:
    """Exact interpolated median of each group, as Spark's ``median``; groups
    without values are left out."""
    counts = value_counts(df, keys, column)
    counts = running(counts, keys, ["_tw_v"], {"_tw_upto": ("sum", F.col("_tw_n")), "_tw_rest": ("rest", F.col("_tw_n"))})
    placed = counts.withColumn("_tw_total", F.col("_tw_upto") + F.col("_tw_rest") - F.col("_tw_n"))
    holds = lambda rank: (F.col("_tw_upto") >= rank) & (F.col("_tw_upto") - F.col("_tw_n") < rank)
    low, high = F.expr("(_tw_total + 1) div 2"), F.expr("(_tw_total + 2) div 2")
    v = F.col("_tw_v").cast("double")
    # half of each, as the interpolation of a percentile does
    return placed.where(holds(low) | holds(high)).groupBy(*keys).agg(
        (F.max(F.when(holds(low), v)) * F.lit(0.5) + F.max(F.when(holds(high), v)) * F.lit(0.5)).alias(alias)
    )


def group_mode(df: DataFrame, keys: Sequence[str], column: str, alias: str) -> DataFrame:
    """The most frequent value of each group, the least of equally frequent ones."""
    counts = value_counts(df, keys, column)
    return counts.groupBy(*keys).agg(F.min_by("_tw_v", F.struct(-F.col("_tw_n"), F.col("_tw_v"))).alias(alias))


def group_chunks(df: DataFrame, keys: Sequence[str], column: str, alias: str, order_by: Sequence[str], most: int) -> DataFrame:
    """A group's values (nulls too) in lists of at most ``most``: one row for
    each ``keys, {alias}_chunk``, numbered from 0 along ``order_by``."""
    rows = df.select(*keys, F.struct(*[F.col(c) for c in order_by]).alias("_tw_o"), F.col(column).alias("_tw_v"), F.spark_partition_id().alias("_tw_p"))
    rows = running(rows, keys, ["_tw_o", "_tw_v", "_tw_p"], {"_tw_nth": ("sum", F.lit(1).cast("long"))})
    rows = rows.withColumn(f"{alias}_chunk", F.expr(f"(_tw_nth - 1) div {int(most)}"))
    lists = F.array_sort(F.collect_list(F.struct("_tw_nth", F.struct("_tw_v").alias("v"))))
    return rows.groupBy(*keys, f"{alias}_chunk").agg(F.transform(lists, lambda x: x["v"]["_tw_v"]).alias(alias))
