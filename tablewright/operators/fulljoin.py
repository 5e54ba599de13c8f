"""Full outer join whose null and hot keys are spread over tasks.

Spark cannot split a skewed partition of a full outer join at run time, and
all rows with a null key, which match nothing, hash to one task.  Here the
join has one more key, the spread:

* a row with a null key gets the number of the map task that reads it, so
  such rows are dealt as widely as they were read;
* a heavy key's rows get, on the side that has more of them, the map task's
  number modulo the key's share count, and the other side's rows of that key
  are repeated once for each share.  A repeated row that finds no partner in
  its share is dropped: the key is known to exist on the other side, so the
  row has its partners in other shares.

Task numbers do not change when a task runs again, so a lost executor changes
nothing.  Each side is read once by the join.  Heavy keys are looked for only
where the sides are large by the optimizer's estimate (or ``find_heavy`` asks):
a frequent-items sketch over the hashed keys of each side names candidates, and
these are counted exactly; both passes read the key columns only.  Keys of
floating or time-zoned types, or of two types, are not looked for.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import field_type
from ..functions.sizing import estimated_bytes

#: Sides whose estimates add up to less are joined without looking for heavy keys.
SKETCH_BYTES = 4 << 30
#: Most heavy keys that are spread; a key beyond them has less than a thousandth of a side.
HEAVY_MOST = 1000

_SPREAD = "_tw_spread"


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(or_, [F.col(k).isNull() for k in keys])


def _placed_by_key(df: DataFrame) -> bool:
    """Read hash-partitioned, as a bucketed table is: the join then needs no
    shuffle, which another key would bring in."""
    return df._jdf.queryExecution().sparkPlan().outputPartitioning().toString().startswith("hashpartitioning")


def _countable(a: T.DataType, b: T.DataType) -> bool:
    """Key types whose values come to the driver and back unchanged."""
    return a == b and isinstance(a, (T.IntegralType, T.StringType, T.DateType, T.DecimalType, T.BooleanType, T.TimestampNTZType))


def heavy_keys(sides: Sequence[tuple[DataFrame, Sequence[str]]], null_safe: bool = False) -> list[tuple[tuple, int, bool]]:
    """Keys with more than an even task's share of the rows of a side:
    ``(key, shares, whether the first side is the one dealt out)``."""
    if not all(_countable(*[field_type(df, ks[i]) for df, ks in sides]) for i in range(len(sides[0][1]))):
        return []
    tasks = int(sides[0][0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts: dict[tuple, list[int]] = {}
    totals, named = [0, 0], []
    for i, (df, keys) in enumerate(sides):
        rows = df.select(*[F.col(k).alias(f"k{j}") for j, k in enumerate(keys)])
        rows = rows if null_safe else rows.where(~_any_null(rows.columns))
        named.append(rows.withColumn("h", F.xxhash64(*rows.columns)))
        top = named[i].agg(F.expr(f"approx_top_k(h, {HEAVY_MOST}, {20 * HEAVY_MOST})").alias("top"), F.count("*").alias("n")).first()
        totals[i] = top.n
        for x in top.top or []:
            if x["count"] * tasks > top.n:
                counts.setdefault(x["item"], [0, 0])
    if not counts:
        return []
    exact: dict[tuple, list[int]] = {}
    for i, rows in enumerate(named):
        keys = [c for c in rows.columns if c != "h"]
        for r in rows.where(F.col("h").isin(list(counts))).groupBy(*keys).count().collect():
            exact.setdefault(tuple(r)[:-1], [0, 0])[i] = r["count"]
    out = []
    for key, n in exact.items():
        first = n[0] * max(1, totals[1]) >= n[1] * max(1, totals[0])
        side = 0 if first else 1
        shares = -(-n[side] * tasks // max(1, totals[side]))
        if shares > 1:
            out.append((key, min(shares, tasks), first))
    return out


def _spread(df: DataFrame, keys: Sequence[str], heavy: DataFrame | None, dealt: str, null_safe: bool) -> DataFrame:
    task = F.spark_partition_id()
    nulls = F.lit(False) if null_safe else _any_null(keys)
    if heavy is None:
        return df.withColumn(_SPREAD, F.when(nulls, task).otherwise(F.lit(0)))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_tw_h{i}")) if null_safe else F.col(k) == F.col(f"_tw_h{i}") for i, k in enumerate(keys)])
    columns = df.columns
    df = df.join(F.broadcast(heavy), same, "left")  # at most 2 * HEAVY_MOST rows
    df = df.withColumn(_SPREAD, F.when(nulls, task).when(F.col(dealt), task % F.col("_tw_shares")).otherwise(F.lit(0)))
    copies = F.when(~F.col(dealt), F.sequence(F.lit(0), F.col("_tw_shares") - 1)).otherwise(F.array(F.col(_SPREAD)))
    return df.select(*columns, F.coalesce(~F.col(dealt), F.lit(False)).alias(f"{dealt}_copy"), F.explode(copies).alias(_SPREAD))


def full_outer(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], *, null_safe: bool = False, find_heavy: bool | None = None
) -> DataFrame:
    """``left`` and ``right`` joined in full on their key pairs, with all
    columns of both (their names have to differ).  ``find_heavy``: None looks
    for heavy keys where the sides are large."""
    same = [F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b) for a, b in zip(left_keys, right_keys)]
    if find_heavy is None:
        find_heavy = estimated_bytes(left) + estimated_bytes(right) >= SKETCH_BYTES
    found = heavy_keys([(left, left_keys), (right, right_keys)], null_safe) if find_heavy else []
    nullable = any(df.schema[c].nullable for df, ks in ((left, left_keys), (right, right_keys)) for c in ks)
    if not found and (null_safe or not nullable or _placed_by_key(left) and _placed_by_key(right)):
        return left.join(right, reduce(and_, same), "full")
    heavy = None
    if found:
        types = ", ".join(f"_tw_h{i} {field_type(left, k).simpleString()}" for i, k in enumerate(left_keys))
        rows = [(*key, shares, first, not first) for key, shares, first in found]
        heavy = left.sparkSession.createDataFrame(rows, f"{types}, _tw_shares int, _tw_left boolean, _tw_right boolean")
    a = _spread(left, left_keys, heavy, "_tw_left", null_safe)
    b = _spread(right, right_keys, heavy, "_tw_right", null_safe).withColumnRenamed(_SPREAD, f"{_SPREAD}_r")
    a, b = a.withColumn("_tw_a", F.lit(True)), b.withColumn("_tw_b", F.lit(True))
    joined = a.join(b, reduce(and_, [*same, F.col(_SPREAD) == F.col(f"{_SPREAD}_r")]), "full")
    if heavy is not None:
        astray = F.col("_tw_left_copy") & F.col("_tw_b").isNull() | F.col("_tw_right_copy") & F.col("_tw_a").isNull()
        joined = joined.where(~F.coalesce(astray, F.lit(False)))
    return joined.select(*left.columns, *right.columns)
