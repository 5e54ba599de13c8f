"""Size checks before a broadcast.

Spark already broadcasts a join side whose estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` (and AQE re-checks with real
sizes at run time).  ``maybe_broadcast`` is the explicit form for callers
who know a side is a small dimension: it hints a broadcast only when the
optimizer's size estimate is under a bound the caller gives, and otherwise
leaves the join to the shuffle strategies.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (from file sizes and
    statistics; no data is read)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, max_bytes: int | None) -> DataFrame:
    if max_bytes is None or estimated_bytes(df) > max_bytes:
        return df
    return F.broadcast(df)
