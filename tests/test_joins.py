"""Joins: FIXTURES cases F12, F14, F15, F29 plus the output contract, null
keys, self joins and the as-of join against brute force."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from table_data import SF_SMALL, ids
from tablewright.operators import joins


@pytest.fixture
def lr(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id bigint, name string")
    right = spark.createDataFrame([(1, 10, "x"), (3, 30, "y"), (None, 0, "z")], "user_id bigint, balance bigint, name string")
    return left, right


def test_inner_join_different_key_names(spark):  # F12
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    right = spark.createDataFrame([(1, 10), (2, 20)], "user_id bigint, balance bigint")
    out = joins.merge_join(left, right, [{"left": "id", "right": "user_id"}], "inner")
    assert out.count() == 2 and "balance" in out.columns and "user_id" not in out.columns


def test_join_output_columns_per_type(lr):
    left, right = lr
    on = [{"left": "id", "right": "user_id"}]
    assert joins.merge_join(left, right, on, "inner").columns == ["id", "name", "balance", "name_right"]
    assert joins.merge_join(left, right, on, "left").columns == ["id", "name", "balance", "name_right"]
    assert joins.merge_join(left, right, on, "right").columns == ["name", "user_id", "balance", "name_right"]
    assert joins.merge_join(left, right, on, "full").columns == ["id", "name", "user_id", "balance", "name_right"]
    assert joins.merge_join(left, right, on, "outer").count() == 5  # 1 match, 2 left-only, 2 right-only
    assert joins.merge_join(left, right, on, "left").count() == 3
    assert joins.merge_join(left, right, on, "right").count() == 3
    assert ids(joins.merge_join(left, right, on, "semi")) == [1]


def test_null_keys_never_match(lr):
    left, right = lr
    out = joins.merge_join(left, right, [{"left": "id", "right": "user_id"}], "inner")
    assert ids(out) == [1]
    safe = joins.merge_join(left, right, [{"left": "id", "right": "user_id"}], "inner", null_safe=True)
    assert safe.count() == 2


def test_suffix_clash_refused(spark):
    left = spark.createDataFrame([(1, "a", "b")], "id bigint, v string, v_right string")
    right = spark.createDataFrame([(1, "c")], "id bigint, v string")
    with pytest.raises(ValueError, match="clashes"):
        joins.merge_join(left, right, ["id"], "inner")


def test_self_join_is_not_ambiguous(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    derived = df.withColumn("v", F.upper("v"))
    out = joins.merge_join(df, derived, ["id"], "full")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 1, "A"), (2, "b", 2, "B")]
    assert out.columns == ["id", "v", "id_right", "v_right"]


def test_anti_join(spark):  # F14
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id bigint")
    right = spark.createDataFrame([(2,), (2,)], "id bigint")
    out = joins.anti_join(left, right, ["id"])
    assert sorted(r.id for r in out.collect() if r.id is not None) == [1, 3]
    assert out.count() == 3  # the null key is kept


def test_anti_join_flag(spark):  # F15
    left = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    right = spark.createDataFrame([(2,), (2,)], "id bigint")
    out = joins.anti_join(left, right, ["id"], flag="missing_in_target")
    assert [r.missing_in_target for r in out.orderBy("id").collect()] == [True, False, True]


def test_inner_and_anti_with_key_pairs(spark):  # F29
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    right = spark.createDataFrame([(1, 10)], "user_id bigint, balance bigint")
    on = [{"left": "id", "right": "user_id"}]
    assert [r.balance for r in joins.merge_join(left, right, on, "inner").collect()] == [10]
    assert ids(joins.anti_join(left, right, on)) == [2]


def test_inner_plus_anti_partition_left(spark):
    left = spark.range(100).withColumn("k", F.col("id") % 7)
    right = spark.range(3).withColumnRenamed("id", "k")
    inner_keys = joins.semi_join(left, right, ["k"]).count()
    anti = joins.anti_join(left, right, ["k"]).count()
    assert inner_keys + anti == 100


def test_mixed_key_forms_refused(spark):
    df = spark.createDataFrame([(1,)], "id bigint")
    with pytest.raises(ValueError):
        joins.anti_join(df, df, ["id", {"left": "id", "right": "id"}])


# ------------------------------------------------------------------ as-of


def _brute_asof(left_rows, right_rows, strategy, tol):
    out = {}
    for lid, lb, lt in left_rows:
        best = None
        for rid, rb, rt in right_rows:
            if lb is None or rb != lb or lt is None or rt is None:
                continue
            if strategy == "backward" and rt <= lt:
                cand = (lt - rt, rid)
            elif strategy == "forward" and rt >= lt:
                cand = (rt - lt, rid)
            elif strategy == "nearest":
                cand = (abs(lt - rt), 0 if rt <= lt else 1, rid)
            else:
                continue
            if best is None or cand < best:
                best = cand
        if best is not None and tol is not None and best[0] > tol:
            best = None
        out[lid] = None if best is None else best[-1]
    return out


@pytest.mark.parametrize("strategy", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("bucket_width", [None, 7.0])
def test_asof_toy_matches_brute_force(spark, strategy, bucket_width):
    left_rows = [(1, "a", 10.0), (2, "a", 25.0), (3, "b", 5.0), (4, "a", None), (5, None, 7.0), (6, "a", 40.0), (7, "c", 1.0)]
    right_rows = [(100, "a", 9.0), (101, "a", 24.0), (102, "a", 26.0), (103, "b", 5.0), (104, "a", 39.0), (105, "a", 60.0)]
    L = spark.createDataFrame(left_rows, "lid int, g string, t double")
    R = spark.createDataFrame(right_rows, "rid int, g string, t double")
    for tol in (None, 1.5):
        out = joins.asof_join(L, R, "t", by="g", strategy=strategy, tolerance=tol, bucket_width=bucket_width)
        got = {r.lid: r.rid for r in out.collect()}
        # brute force picks the smallest gap; ties between equal gaps never occur in this fixture
        assert got == _brute_asof(left_rows, right_rows, strategy, tol), (strategy, tol)
        assert out.count() == len(left_rows)


def test_asof_without_by(spark):
    L = spark.createDataFrame([(1, 10.0), (2, 3.0)], "lid int, t double")
    R = spark.createDataFrame([(9, 2.0), (8, 9.5)], "rid int, t double")
    out = {r.lid: r.rid for r in joins.asof_join(L, R, "t", bucket_width=1.0).collect()}
    assert out == {1: 8, 2: 9}


def test_asof_events_against_brute_force(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    p = ev.filter("event_type = 'purchase'")
    v = ev.filter("event_type = 'view'")
    lrows = [(r.event_id, r.user_id, r.ts) for r in p.collect()]
    rrows = [(r.event_id, r.user_id, r.ts) for r in v.collect()]
    day = dt.timedelta(days=1)
    for strategy in ("backward", "forward", "nearest"):
        # a small bucket width forces many buckets, so the carried rows are exercised
        out = joins.asof_join(p, v, "ts", by="user_id", strategy=strategy, tolerance=day, bucket_width=3_600_000_000.0)
        got = {r.event_id: r.event_id_right for r in out.collect()}
        assert got == _brute_asof(lrows, rrows, strategy, day)
        # the tie-collapsing plan gives the same answer
        out = joins.asof_join(p, v, "ts", by="user_id", strategy=strategy, tolerance=day, rows_per_bucket=200, collapse_ties=True)
        assert {r.event_id: r.event_id_right for r in out.collect()} == got


def test_broadcast_only_under_checked_size(spark):
    from tablewright.functions.sizing import estimated_bytes

    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
        nation = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
        cust = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
        size = estimated_bytes(nation)
        small = joins.merge_join(cust, nation, [{"left": "c_nationkey", "right": "n_nationkey"}], "inner", broadcast_max_bytes=size + 1)
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
        big = joins.merge_join(orders, cust, [{"left": "o_custkey", "right": "c_custkey"}], "inner", broadcast_max_bytes=size)
        plan = big._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        assert small.count() == cust.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_asof_keeps_large_integers_and_decimals_exact(spark):
    big = 2**53
    left = spark.createDataFrame([(1, big), (2, big + 2), (3, -big - 1)], "id int, at bigint")
    right = spark.createDataFrame([(big + 1, "b"), (-big - 2, "a")], "at bigint, v string")
    for strategy, want in (("backward", ["a", "b", "a"]), ("forward", ["b", None, "b"])):
        for t in ("bigint", "decimal(30,2)"):
            l, r = left.withColumn("at", left.at.cast(t)), right.withColumn("at", right.at.cast(t))
            got = joins.asof_join(l, r, "at", strategy=strategy, rows_per_bucket=2).collect()
            assert [x.v for x in sorted(got, key=lambda x: x.id)] == want
