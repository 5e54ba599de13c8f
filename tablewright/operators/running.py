"""Running values along an order, for groups of any size.

A window function puts a whole group into one task.  Here the rows are sorted
into range partitions by group and order and written once; values run within a
partition's share of a group, and what the other shares hold comes from a table
of one row for each group and share.  A group that holds all rows is spread
over all partitions, and nothing but row counts reaches the driver.

Kinds: ``sum`` and ``xor`` of the rows up to and with this one, ``rest`` (the
sum from this row on), ``last``
(the last value so far that is not null) and ``next`` (the first from this row
on that is not null).
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import maybe_broadcast
from ..sources.sinks import write_staging

Totals = dict[str, tuple[str, Column]]

#: The table of shares is broadcast up to this size.
SHARES_BYTES = 8 << 20

_BACK = (Window.unboundedPreceding, Window.currentRow)
#: Kinds that look ahead run back from the end: Spark computes a frame that
#: ends there anew at every row, in time that grows with the square.
_AHEAD = ("rest", "next")


def _along(kind: str, partition: Sequence[str], order: Sequence[str]):
    """The window of a kind, in which all frames begin with the first row."""
    places = [F.col(c).desc_nulls_last() if kind in _AHEAD else F.col(c).asc_nulls_first() for c in order]
    return Window.partitionBy(*partition).orderBy(*places)


def _local(kind: str, c: Column, window) -> Column:
    window = window.rowsBetween(*_BACK)
    if kind in ("sum", "rest"):
        return F.sum(c).over(window)
    if kind == "xor":
        return F.bit_xor(c).over(window)
    if kind in ("last", "next"):
        return F.last(c, ignorenulls=True).over(window)
    raise ValueError(f"no running value {kind!r}")


def _of_share(kind: str, c: Column, order: Sequence[str]) -> Column:
    place = F.when(c.isNotNull(), F.struct(*order))
    return {"sum": F.sum, "rest": F.sum, "xor": F.bit_xor, "last": lambda x: F.max_by(x, place), "next": lambda x: F.min_by(x, place)}[kind](c)


def _of_others(kind: str, c: Column, window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    if kind in ("sum", "rest"):
        return F.coalesce(F.sum(c).over(before), F.lit(0))
    if kind == "xor":
        return F.coalesce(F.bit_xor(c).over(before), F.lit(0))
    return F.last(c, ignorenulls=True).over(before)


def _joined(kind: str, own: Column, others: Column) -> Column:
    if kind in ("sum", "rest"):
        return own + others
    return own.bitwiseXOR(others) if kind == "xor" else F.coalesce(own, others)


def running_in_windows(df: DataFrame, group: Sequence[str], order: Sequence[str], totals: Totals) -> DataFrame:
    """The same values by plain windows: each group in one task."""
    return df.select("*", *[_local(kind, c, _along(kind, group, order)).alias(name) for name, (kind, c) in totals.items()])


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], totals: Totals, shares: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``totals`` (name: kind and value; the
    value of a sum or xor is never null).  ``order`` has to tell the rows of a
    group apart where their order matters.  ``shares``: number of range
    partitions, by default Spark's."""
    group, order = list(group), list(order)
    share = [*group, "_tw_share"]
    df = df.select("*", *[c.alias(f"_tw_in_{name}") for name, (_, c) in totals.items()])
    df = df.repartitionByRange(*([shares] if shares else []), *group, *order)
    df = write_staging(df.withColumn("_tw_share", F.spark_partition_id()))
    sums = df.groupBy(*share).agg(*[_of_share(kind, F.col(f"_tw_in_{name}"), order).alias(name) for name, (kind, _) in totals.items()])
    others = {f"_tw_other_{n}": _of_others(kind, F.col(n), _along(kind, group, ["_tw_share"])) for n, (kind, _) in totals.items()}
    sums = write_staging(sums.select(*share, *[c.alias(n) for n, c in others.items()]))
    df = df.select("*", *[_local(kind, F.col(f"_tw_in_{name}"), _along(kind, share, order)).alias(name) for name, (kind, _) in totals.items()])
    names = {c: f"_tw_key{i}" for i, c in enumerate(share)}
    sums = sums.withColumnsRenamed(names)
    df = df.join(maybe_broadcast(sums, SHARES_BYTES), reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]))
    for name, (kind, _) in totals.items():
        df = df.withColumn(name, _joined(kind, F.col(name), F.col(f"_tw_other_{name}")))
    return df.drop("_tw_share", *names.values(), *[f"_tw_{x}_{name}" for x in ("in", "other") for name in totals])
