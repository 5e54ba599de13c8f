"""As-of join: for each left row the nearest right row in time.

Right rows are first reduced to one for each (``by``, time), the greatest, so
ties are settled before any sort.  Both sides are then one ordered sequence for
each ``by`` key, and a left row's match is the last right row so far or the
next one from here on: running values (``running``).  Small inputs use plain
windows.  Large ones, by the optimizer's estimate, are sorted into range
partitions by key and time, and the last and first right row of each partition
are carried over a table of partitions; neither a hot key, nor no key at all,
nor a burst of rows in a short time puts more in one task than its share.
"""
from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import field_type, ident, idents, require_columns, suffixed_names
from ..functions.sizing import estimated_bytes
from .running import running, running_in_windows

#: Inputs estimated at less are joined by plain windows.
WINDOW_BYTES = 256 << 20

ASOF_STRATEGIES = ("backward", "forward", "nearest")
_UNIT_SECONDS = {"w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1, "ms": 0.001, "us": 0.000001}
_DURATION = re.compile(r"(\d+(?:\.\d+)?)(ms|us|w|d|h|m|s)")


def _parse_duration_seconds(text: str) -> float:
    pos, total = 0, 0.0
    s = text.strip().lower()
    for m in _DURATION.finditer(s):
        if m.start() != pos:
            raise ValueError(f"bad duration {text!r}")
        total += float(m.group(1)) * _UNIT_SECONDS[m.group(2)]
        pos = m.end()
    if pos != len(s) or not s:
        raise ValueError(f"bad duration {text!r}")
    return total


def _key_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """A type that holds numeric keys of both sides exactly: long for
    integers, decimal where a decimal takes part, double for floats."""
    both = (left, right)
    if all(isinstance(t, T.IntegralType) for t in both):
        return T.LongType()
    if all(isinstance(t, (T.IntegralType, T.DecimalType)) for t in both):
        return T.DecimalType(38, max(t.scale for t in both if isinstance(t, T.DecimalType)))
    return T.DoubleType()


def _time_key(col: Column, dt: T.DataType, numeric: T.DataType) -> tuple[Column, float]:
    """Ordering key for ``on`` and the number of key units per second
    (timestamps: microseconds; dates: days; numbers: the value)."""
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        epoch = F.lit("1970-01-01 00:00:00").cast(dt.simpleString())
        return F.timestamp_diff("MICROSECOND", epoch, col), 1_000_000.0
    if isinstance(dt, T.DateType):
        return F.unix_date(col).cast("long"), 1 / 86400
    if isinstance(dt, T.NumericType):
        return col.cast(numeric), 1.0
    raise ValueError(f"as-of key must be numeric, date or timestamp, not {dt.simpleString()}")


def _tolerance_units(tolerance, dt: T.DataType, per_second: float) -> float | None:
    if tolerance is None:
        return None
    if isinstance(tolerance, str):
        if not isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise ValueError("a duration tolerance needs a date or timestamp key")
        return _parse_duration_seconds(tolerance) * per_second
    if hasattr(tolerance, "total_seconds"):
        return tolerance.total_seconds() * per_second
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return float(tolerance) * per_second  # plain numbers are seconds
    return float(tolerance)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    *,
    right_on: str | None = None,
    by: str | Sequence[str] | None = None,
    strategy: str = "backward",
    tolerance=None,
    suffix: str = "_right",
    rows_per_bucket: int | None = None,
    bucket_width: float | None = None,
    max_buckets: int | None = None,
    collapse_ties: bool | None = None,
) -> DataFrame:
    """For each left row, the right row with the nearest ``right_on`` value
    not after (backward), not before (forward) or closest to (nearest, ties go
    backward) the left ``on`` value, within equal ``by`` keys.  Every left row
    appears once; unmatched rows get nulls.  ``tolerance`` caps the gap
    (numbers, seconds, a ``timedelta`` or text like ``"1d"`` / ``"2h30m"``).
    Of right rows with equal key and time the greatest is matched.

    ``rows_per_bucket`` asks for range partitions of about so many rows (the
    rows are counted), ``max_buckets`` caps their number.  ``bucket_width``
    and ``collapse_ties``, of earlier requests, ask for range partitions too
    and change nothing else: ties are always reduced, widths follow the rows.
    """
    if strategy not in ASOF_STRATEGIES:
        raise ValueError(f"strategy must be one of {ASOF_STRATEGIES}, not {strategy!r}")
    lon = ident(on)
    ron = ident(right_on or on)
    bys = [by] if isinstance(by, str) else list(by or [])
    bys = idents(bys, allow_empty=True)
    require_columns(left, [lon, *bys], where="left input")
    require_columns(right, [ron, *bys], where="right input")
    ldt, rdt = field_type(left, lon), field_type(right, ron)
    if type(ldt) is not type(rdt) and not (isinstance(ldt, T.NumericType) and isinstance(rdt, T.NumericType)):
        raise ValueError(f"as-of keys differ in type: {ldt.simpleString()} vs {rdt.simpleString()}")
    numeric = _key_type(ldt, rdt)
    lkey, per_second = _time_key(F.col(lon), ldt, numeric)
    rkey, _ = _time_key(F.col(ron), rdt, numeric)
    tol = _tolerance_units(tolerance, ldt, per_second)
    by_l = {b.lower() for b in bys}
    payload = [c for c in right.columns if c.lower() not in by_l]
    names = suffixed_names(left.columns, payload, suffix)

    keys = [f"_tw_by{i}" for i in range(len(bys))]
    usable = reduce(and_, [F.col(k).isNotNull() for k in [*keys, "_tw_t"]])
    own_keys = [F.col(b).alias(k) for b, k in zip(bys, keys)]
    lefts = left.select(*own_keys, lkey.alias("_tw_t"), F.struct(*[F.col(c) for c in left.columns]).alias("_tw_l"))
    row = F.struct(*[F.col(c).alias(names[c]) for c in payload], F.col("_tw_t").alias("_tw_rt"))
    rights = right.select(*own_keys, rkey.alias("_tw_t"), *[F.col(c) for c in payload]).where(usable)
    rights = rights.select(*keys, "_tw_t", row.alias("_tw_r")).groupBy(*keys, "_tw_t").agg(F.max("_tw_r").alias("_tw_r"))
    no_left, no_right = (F.lit(None).cast(df.schema[c].dataType) for df, c in ((lefts, "_tw_l"), (rights, "_tw_r")))
    # at equal times the right row comes first; left rows are told apart by
    # the task that reads them, so many at one time are many ranges
    both = rights.select(*keys, "_tw_t", F.lit(0).alias("_tw_s"), no_left.alias("_tw_l"), "_tw_r").unionByName(
        lefts.where(usable).select(*keys, "_tw_t", (F.spark_partition_id() + 1).alias("_tw_s"), "_tw_l", no_right.alias("_tw_r"))
    )
    order = ["_tw_t", "_tw_s"]
    totals = {"_tw_back": ("last", F.col("_tw_r"))}
    if strategy != "backward":
        totals["_tw_next"] = ("next", F.col("_tw_r"))
    asked = any(x is not None for x in (rows_per_bucket, bucket_width, max_buckets, collapse_ties))
    if not asked and estimated_bytes(left) + estimated_bytes(right) < WINDOW_BYTES:
        out = running_in_windows(both, keys, order, totals)
    else:
        shares = None
        if rows_per_bucket:
            shares = max(1, -(-(left.count() + right.count()) // rows_per_bucket))
            shares = min(shares, max_buckets) if max_buckets else shares
        out = running(both, keys, order, totals, shares or max_buckets)
    out = out.where("_tw_s > 0")
    back, ahead = F.col("_tw_back"), F.col("_tw_next") if strategy != "backward" else None
    gap = F.col("_tw_t") - back["_tw_rt"]
    if strategy == "backward":
        pick = back
    else:
        # a right row at the very time comes before the left row in order
        ahead = F.when(gap == 0, back).otherwise(ahead)
        gap_ahead = ahead["_tw_rt"] - F.col("_tw_t")
        use_back = ahead.isNull() | back.isNotNull() & (gap <= gap_ahead) if strategy == "nearest" else F.lit(False)
        pick, gap = F.when(use_back, back).otherwise(ahead), F.when(use_back, gap).otherwise(gap_ahead)
    pick = pick if tol is None else F.when(gap <= F.lit(tol), pick)
    matched = out.select("_tw_l", pick.alias("_tw_m")).unionByName(lefts.where(~usable).select("_tw_l", no_right.alias("_tw_m")))
    return matched.select(*[F.col("_tw_l").getField(c).alias(c) for c in left.columns], *[F.col("_tw_m").getField(n).alias(n) for n in names.values()])
