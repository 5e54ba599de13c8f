"""Groups of any size: running values, median and mode, chunked lists,
comparison by digests, exact samples among equal rows, empty tables."""
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.operators import aggregate as agg
from tablewright.operators import compare, digests, rows
from tablewright.operators.running import running, running_in_windows


def test_running_values_equal_windows(spark):
    rnd = random.Random(2)
    data = [(None if i % 3 == 0 else rnd.choice(["a", "b"]), i, rnd.choice([None, i])) for i in range(900)]
    df = spark.createDataFrame(data, "g string, i int, v int").repartition(7)
    totals = {
        "n": ("sum", F.lit(1).cast("long")), "x": ("xor", F.xxhash64("i")), "back": ("last", F.col("v")), "ahead": ("next", F.col("v")),
        "rest": ("rest", F.col("i").cast("long")),
    }
    for group in (["g"], []):
        got = running(df, group, ["i"], totals, shares=9)
        assert got.columns == ["g", "i", "v", *totals]
        want = running_in_windows(df, group, ["i"], totals)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        running_in_windows(df, [], ["i"], {"q": ("product", F.col("i"))})


def test_no_frame_ends_with_the_last_row(spark):
    # Spark adds such a frame up anew at every row
    df = spark.range(50).select((F.col("id") % 2).alias("g"), "id")
    totals = {"rest": ("rest", F.col("id")), "ahead": ("next", F.col("id"))}
    median = agg.aggregate(df, ["g"], [{"column": "id", "agg": "median"}], large_groups=True)
    for out in (median, running(df, ["g"], ["id"], totals), running_in_windows(df, ["g"], ["id"], totals)):
        plan = out._jdf.queryExecution().executedPlan().toString().lower()
        assert "currentrow$()" in plan and "unboundedfollowing" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_median_and_mode_of_large_groups(spark, seed):
    rnd = random.Random(seed)
    data = [(rnd.choice([None, 1, 1, 1, 2, 3]), rnd.choice([None, *range(8)]), rnd.uniform(-5, 5)) for _ in range(401)]
    data += [(9, None, None), (9, None, None)]
    df = spark.createDataFrame(data, "g int, v int, x double").repartition(5)
    metrics = [{"column": "v", "agg": "median"}, {"column": "v", "agg": "mode"}, {"column": "x", "agg": "median"}, {"column": "v", "agg": "count"}]
    for keys in (["g"], []):
        got, plain = (agg.aggregate(df, keys, metrics, large_groups=x) for x in (True, False))
        assert got.columns == plain.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    for r in agg.aggregate(df, ["g"], metrics, large_groups=True).collect():
        values = [v for g, v, _ in data if g == r.g and v is not None]
        counts = Counter(values)
        assert r.v_median == (statistics.median(values) if values else None)
        assert r.v_mode == (min(v for v in counts if counts[v] == max(counts.values())) if values else None)


def test_no_buffer_holds_a_group(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.rand(3).alias("x"))
    out = agg.aggregate(df, ["g"], [{"column": "x", "agg": "median"}, {"column": "x", "agg": "mode"}], large_groups=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "mode(" not in plan and "collect_list" not in plan


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g int, v int")
    metrics = [{"column": "v", "agg": a} for a in ("n_unique", "approx_n_unique", "count", "median", "mode")]
    want = {"v_n_unique": 0, "v_approx_n_unique": 0, "v_count": 0, "v_median": None, "v_mode": None}
    for large in (True, False):
        assert [r.asDict() for r in agg.aggregate(empty, [], metrics, large_groups=large).collect()] == [want]
        assert agg.aggregate(empty, ["g"], metrics, large_groups=large).collect() == []
    assert agg.aggregate(empty, ["g"], [{"column": "v", "agg": "implode"}], order_by=["v"]).collect() == []


def test_implode_in_chunks(spark):
    data = [(i % 2 if i < 50 else 5, None if i % 7 == 0 else i, i) for i in range(300)]
    df = spark.createDataFrame(data, "g int, v int, i int").repartition(6)
    got = agg.aggregate(df, ["g"], [{"column": "v", "agg": "implode", "alias": "vs"}], order_by=["i"], chunk_rows=20).collect()
    assert all(1 <= len(r.vs) <= 20 for r in got)
    for g in (0, 1, 5):
        chunks = sorted((r.vs_chunk, r.vs) for r in got if r.g == g)
        assert [c for c, _ in chunks] == list(range(len(chunks)))
        assert [v for _, vs in chunks for v in vs] == [v for h, v, _ in sorted(data, key=lambda r: r[2]) if h == g]
    with pytest.raises(ValueError, match="order_by"):
        agg.aggregate(df, ["g"], [{"column": "v", "agg": "implode"}])
    with pytest.raises(ValueError, match="alone"):
        agg.aggregate(df, ["g"], [{"column": "v", "agg": "implode"}, {"column": "v", "agg": "sum"}], order_by=["i"])


def test_sketches_merge_over_loads(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), (F.col("id") % 1999).alias("v"), F.col("id").cast("decimal(10,2)").alias("d"))
    loads = [agg.aggregate(df.where(F.col("id") % 3 == i), ["g"], [{"column": "v", "agg": "sketch", "alias": "s"}]) for i in range(3)]
    all_of = loads[0].unionByName(loads[1]).unionByName(loads[2])
    for r in agg.merge_sketches(all_of, ["g"], "s", estimate="n").collect():
        assert abs(r.n - 1999) < 0.05 * 1999
    (r,) = agg.merge_sketches(all_of, [], "s", estimate="n").collect()
    assert abs(r.n - 1999) < 0.05 * 1999
    assert agg.aggregate(df, [], [{"column": "d", "agg": "sketch"}]).count() == 1


def test_no_sketch_for_each_distinct_value(spark):
    data = [(None if i % 4 == 0 else i % 4, None if i % 10 == 0 else i % 997) for i in range(4000)]
    df = spark.createDataFrame(data, "g int, v int")
    metrics = [{"column": "v", "agg": a} for a in ("n_unique", "approx_n_unique", "sketch", "len")]
    for keys in (["g"], []):
        out = agg.aggregate(df, keys, metrics)
        assert out.columns == [*keys, *[f"v_{m['agg']}" for m in metrics]]
        rows = out.collect()
        assert len(rows) == (4 if keys else 1)
        for r in rows:
            values = [v for g, v in data if not keys or g == r.g]
            assert r.v_len == len(values) and r.v_n_unique == len(set(values))
            assert abs(r.v_approx_n_unique - r.v_n_unique) <= 0.05 * r.v_n_unique
        steps = out._jdf.queryExecution().executedPlan().toString().splitlines()
        sketches = [x for x in steps if "approx_count_distinct" in x or "hll_sketch" in x]
        assert sketches and all(f"keys=[{', '.join(keys)}" in x and ", v#" not in x.split("functions=")[0] for x in sketches)
        assert not any("v#" in x.split("functions=")[0] or "count(distinct" in x for x in sketches)


@pytest.mark.parametrize("changes", [0, 3, 400])
def test_changes_by_digests_equal_the_whole_comparison(spark, changes):
    rnd = random.Random(changes)
    a = [(None if i % 50 == 0 else i, rnd.choice(["x", "y", None]), float(i)) for i in range(2000)]
    b = [list(r) for r in a]
    for i in rnd.sample(range(2000), changes):
        b[i][rnd.choice([0, 1, 2])] = None
    b = [tuple(r) for r in b] + [(5000 + i, "new", 0.0) for i in range(min(changes, 2))]
    left, right = (spark.createDataFrame(x, "k int, s string, v double").repartition(4) for x in (a, b))
    for f, same in ((compare.reconcile, "MATCHED"), (compare.delta, "UNCHANGED"), (compare.snapshot_diff, "UNCHANGED")):
        got = f(left, right, ["k"], ["s", "v"], 0.25, only_changes=True)
        want = f(left, right, ["k"], ["s", "v"], 0.25)
        status = want.columns[-1]
        assert sorted(map(str, got.collect())) == sorted(map(str, want.where(F.col(status) != same).collect()))


def test_only_ranges_that_differ_are_joined(spark):
    left = spark.range(20_000).select("id", (F.col("id") % 7).alias("v"))
    right = left.withColumn("v", F.when(F.col("id").isin(5, 77, 12_345), -1).otherwise(F.col("v"))).where("id <> 9")
    a, b = digests.differing(left, right, ["id"], ["v"])
    assert a.count() <= 6 and b.count() <= 6  # four changes, and what shares their range
    a, b = digests.differing(left, left.repartition(3), ["id"], ["v"])
    assert a.count() == b.count() == 0
    # rows that occur twice do not cancel
    twice = spark.createDataFrame([(1, 1), (1, 1)], "id int, v int")
    other = spark.createDataFrame([(2, 2), (2, 2)], "id int, v int")
    a, b = digests.differing(twice, other, ["id"], ["v"], bits=(1, 2))
    assert a.count() == b.count() == 2


def test_exact_sample_among_equal_rows(spark):
    equal = spark.range(0, 900, numPartitions=6).select(F.lit("same").alias("s"), F.lit(1).alias("n"))
    other = spark.range(0, 300, numPartitions=2).select(F.concat(F.lit("o"), "id").alias("s"), F.lit(2).alias("n"))
    for fraction in (0.1, 0.5, 0.9, 1.0):
        got = rows.sample_rows(equal.union(other), fraction, seed=4, exact=True)
        assert got.columns == ["s", "n"] and got.count() == int(1200 * fraction)
    some = rows.sample_rows(equal, 0.5, seed=4, exact=True)
    made = [r.n for r in some.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(made) == 450 and max(made) <= 300  # 150 a task, at most two of them together
