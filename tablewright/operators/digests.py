"""Ranges of keys in which two datasets differ, found by digests.

Every row gets a range from the leading bits of its key's hash, and a digest
of its key and values.  The digests of a range are added up, for the first
dataset with a plus and for the second with a minus, in one aggregate: where
all sums are zero the range holds the same rows on both sides.  Ranges that
differ are looked at again in finer ones.  What is shuffled are sums, at most
one row for each map task and range, and rows of ranges that differ.

Sums of 32-bit halves of two 64-bit hashes do not depend on the order of rows
and do not cancel for rows that occur twice.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import maybe_broadcast
from ..sources.sinks import write_staging

#: Leading bits of the key's hash in the first and in the finer look.
BITS = (16, 32)
BROADCAST_BYTES = 32 << 20

_NO_KEY = -1


def _range(keys: Sequence[str], bits: int) -> Column:
    """Rows with a null key are in a range of their own."""
    none = reduce(or_, [F.col(k).isNull() for k in keys])
    return F.when(none, F.lit(_NO_KEY)).otherwise(F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits))


def _signed(df: DataFrame, keys: Sequence[str], values: Sequence[str], bits: int, sign: int) -> DataFrame:
    parts = []
    for salt in (0, 1):
        h = F.xxhash64(F.lit(salt), *keys, *values)
        parts += [sign * h.bitwiseAND(F.lit(0xFFFFFFFF)), sign * F.shiftrightunsigned(h, 32)]
    return df.select(_range(keys, bits).alias("_tw_range"), F.lit(sign).alias("d"), *[p.alias(f"d{i}") for i, p in enumerate(parts)])


def _within(df: DataFrame, keys: Sequence[str], ranges: DataFrame, bits: int) -> DataFrame:
    side = maybe_broadcast(ranges, BROADCAST_BYTES).withColumnRenamed("_tw_range", "_tw_r")
    return df.join(side, _range(keys, bits) == F.col("_tw_r"), "left_semi")


def differing(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], bits: tuple[int, int] = BITS) -> tuple[DataFrame, DataFrame]:
    """The rows of ``a`` and ``b`` in ranges that differ, those with a null
    key among them.  Where more than half of the first ranges differ the
    finer look would gain nothing and is left out."""
    ranges, width = None, bits[0]
    for width in bits:
        x, y = (df if ranges is None else _within(df, keys, ranges, bits[0]) for df in (a, b))
        sums = _signed(x, keys, values, width, 1).unionByName(_signed(y, keys, values, width, -1))
        totals = {c: F.sum(c).alias(c) for c in sums.columns if c != "_tw_range"}
        sums = sums.groupBy("_tw_range").agg(*totals.values())
        uneven = reduce(or_, [F.col(c) != 0 for c in totals]) | (F.col("_tw_range") == _NO_KEY)
        ranges = write_staging(sums.where(uneven).select("_tw_range"))
        if 2 * ranges.count() > 1 << width:
            break
    return _within(a, keys, ranges, width), _within(b, keys, ranges, width)
