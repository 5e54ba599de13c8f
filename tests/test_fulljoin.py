"""Full outer joins with null and hot keys: equal to a plain join, and even."""
import random

import pytest
from pyspark.sql import functions as F

from table_data import SF_SMALL
from tablewright.operators import compare, fulljoin, joins
from tablewright.plans import runner


def plain(left, right, lkeys, rkeys, null_safe=False):
    same = lambda x, y: x == y if x is not None and y is not None else null_safe and x is None and y is None
    match = lambda a, b: all(same(a[i], b[j]) for i, j in zip(lkeys, rkeys))
    out = [(*a, *b) for a in left for b in right if match(a, b)]
    out += [(*a, *[None] * len(right[0])) for a in left if not any(match(a, b) for b in right)]
    out += [(*[None] * len(left[0]), *b) for b in right if not any(match(a, b) for a in left)]
    return sorted(out, key=str)


def skewed(seed, n, hot, nulls=0.3):
    """Rows (key, other key, number): a share of null keys, one hot key, some keys on one side only."""
    rnd = random.Random(seed)
    return [(None if rnd.random() < nulls else hot if rnd.random() < 0.5 else rnd.randrange(40), rnd.choice(["x", "y", None]), i) for i in range(n)]


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("find", [False, True])
def test_equal_to_all_pairs(spark, find, null_safe):
    for seed, hot_l, hot_r in [(1, 5, 5), (2, 5, 99), (3, 77, 8)]:
        a, b = skewed(seed, 150, hot_l), skewed(seed + 10, 40, hot_r)
        left = spark.createDataFrame(a, "k int, g string, i int").repartition(5)
        right = spark.createDataFrame(b, "k int, g string, i int").repartition(3)
        got = joins.merge_join(left, right, ["k"], "full", null_safe=null_safe, split_full_join=find)
        assert got.columns == ["k", "g", "i", "k_right", "g_right", "i_right"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(a, b, [0], [0], null_safe)
        two = joins.merge_join(left, right, ["g", "k"], "full", null_safe=null_safe, split_full_join=find)
        assert sorted(map(tuple, two.collect()), key=str) == plain(a, b, [1, 0], [1, 0], null_safe)


def test_heavy_keys_are_counted_exactly(spark):
    a, b = skewed(1, 3000, 5, nulls=0.2), skewed(2, 500, 7, nulls=0.2)
    left, right = (spark.createDataFrame(x, "k long, g string, i int") for x in (a, b))
    found = {key: (shares, first) for key, shares, first in fulljoin.heavy_keys([(left, ["k"]), (right, ["k"])])}
    assert set(found) == {(5,), (7,)} and found[(5,)][1] and not found[(7,)][1]
    assert all(2 <= shares <= 8 for shares, _ in found.values())
    assert fulljoin.heavy_keys([(left, ["k"]), (right.withColumn("k", F.col("k").cast("int")), ["k"])]) == []  # two types
    assert fulljoin.heavy_keys([(left.limit(0), ["k"]), (right.limit(0), ["k"])]) == []


def rows_by_task(df):
    """Rows of the join's output by the task that made them."""
    return sorted(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


def test_tasks_are_even_with_nulls_and_a_hot_key(spark):
    """A third of the rows null, a third with one key: no task has twice the
    mean; with a plain join one task has more than three times."""
    n = 48_000
    key = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(-1)).otherwise(F.col("id"))
    left = spark.range(n, numPartitions=64).select(key.alias("k"), F.col("id").alias("a"))
    right = spark.range(0, n, 4, numPartitions=32).select(F.when(F.col("id") % 12 == 0, None).otherwise(F.col("id") % 9001 - 1).alias("k"), F.col("id").alias("b"))
    right = right.where("k is null or k >= 0 or b = 9001 * 4")  # one partner for the hot key at most
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        even = rows_by_task(joins.merge_join(left, right, ["k"], "full", split_full_join=True))
        r = right.withColumnRenamed("k", "k2")
        odd = rows_by_task(left.join(r, F.col("k") == F.col("k2"), "full"))
        split = joins.merge_join(left, right, ["k"], "full", split_full_join=True)
        again = left.join(r, F.col("k") == F.col("k2"), "full")
        assert split.exceptAll(again.toDF(*split.columns)).count() == 0 == again.toDF(*split.columns).exceptAll(split).count()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(even) == sum(odd) and max(even) < 2 * sum(even) / 8 and max(odd) > 3 * sum(odd) / 8


def test_each_side_is_scanned_once(spark):
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_custkey")
    customer = spark.read.parquet(f"{SF_SMALL}/customer.parquet").select("c_custkey", "c_name")
    out = joins.merge_join(customer, orders, [{"left": "c_custkey", "right": "o_custkey"}], "full")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Join") == 1


def test_comparisons_find_heavy_keys_too(spark):
    a, b = skewed(4, 400, 3, nulls=0.3), skewed(5, 90, 3, nulls=0.3)
    left, right = (spark.createDataFrame(x, "k int, g string, i int").repartition(4) for x in (a, b))
    for f in (compare.reconcile, compare.delta, compare.snapshot_diff):
        got, want = (sorted(map(str, f(left, right, ["k"], ["g"], split_full_join=x).collect())) for x in (True, False))
        assert got == want and len(got) > 400


def test_a_request_can_ask_for_it(spark, tmp_path):
    rows = [(1, "a"), (None, "b"), (2, "c"), (2, "d")]
    for name in ("l", "r"):
        spark.createDataFrame(rows, f"k int, {name} string").write.parquet(str(tmp_path / name))

    def ask(config):
        step = {"action": "action-merge-join", "name": "j", "input": ["l", "r"], "config": {"type": "full", "on": ["k"], **config}}
        sources = [{"name": n, "path": str(tmp_path / n)} for n in ("l", "r")]
        return runner.build(spark, {"sources": sources, "actions": [step], "options": {"final_dataset": "j"}}).final

    assert ask({}).count() == 1 + 2 + 4 and ask({"split_full_join": True}).count() == 7
    assert ask({"null_safe": True}).count() == 1 + 1 + 4
