"""Union and aggregation (F13 plus the N1/N3 rules)."""
import pytest

from tablewright.operators import aggregate as agg
from tablewright.operators import setops


def test_union_all_and_distinct(spark):  # F13
    a = spark.createDataFrame([(1,), (2,)], "id bigint")
    b = spark.createDataFrame([(2,), (3,)], "id bigint")
    assert setops.union([a, b], "union_all").count() == 4
    assert setops.union([a, b], "union").count() == 3


def test_union_strict_checks(spark):
    a = spark.createDataFrame([(1, "x")], "id bigint, v string")
    b = spark.createDataFrame([(1,)], "id bigint")
    c = spark.createDataFrame([("1", "x")], "id string, v string")
    with pytest.raises(ValueError, match="align_schema"):
        setops.union([a, b])
    with pytest.raises(ValueError, match="bigint"):
        setops.union([a, c])
    out = setops.union([a, b], align_schema=True)
    assert sorted((r.id, str(r.v)) for r in out.collect()) == [(1, "None"), (1, "x")]
    with pytest.raises(ValueError):
        setops.union([a])


def test_union_by_name_not_position(spark):
    a = spark.createDataFrame([(1, "x")], "id bigint, v string")
    b = spark.createDataFrame([("y", 2)], "v string, id bigint")
    assert sorted((r.id, r.v) for r in setops.union([a, b]).collect()) == [(1, "x"), (2, "y")]


def test_union_distinct_nulls_equal(spark):
    a = spark.createDataFrame([(None,), (None,)], "id bigint")
    assert setops.union([a, a], "union").count() == 1


def test_metrics(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1, "p"), ("a", 2.0, 2, None), ("a", 4.0, 3, "q"), ("a", 9.0, 4, "p"), ("b", None, 1, None)],
        "g string, x double, t int, s string",
    )
    out = agg.aggregate(
        df,
        ["g"],
        [
            {"column": "x", "agg": "sum"},
            {"column": "x", "agg": "median"},
            {"column": "x", "agg": "mean"},
            {"column": "x", "agg": "count"},
            {"column": "s", "agg": "n_unique"},
            {"column": "x", "agg": "first"},
            {"column": "x", "agg": "last"},
            {"column": "x", "agg": "null_count"},
            {"column": "x", "agg": "len"},
        ],
        order_by=["t"],
    )
    r = {row.g: row for row in out.collect()}
    assert r["a"].x_sum == 16.0 and r["a"].x_median == 3.0 and r["a"].x_mean == 4.0 and r["a"].x_count == 4
    assert r["a"].s_n_unique == 3  # p, q and null
    assert r["a"].x_first == 1.0 and r["a"].x_last == 9.0
    assert r["b"].x_sum is None  # SQL rule for an all-null group
    assert r["b"].x_null_count == 1 and r["b"].x_len == 1 and r["b"].s_n_unique == 1
    zero = agg.aggregate(df, ["g"], [{"column": "x", "agg": "sum"}], null_sum_as_zero=True)
    assert {row.g: row.x_sum for row in zero.collect()}["b"] == 0


def test_first_last_need_order(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, x double")
    with pytest.raises(ValueError, match="order_by"):
        agg.aggregate(df, ["g"], [{"column": "x", "agg": "first"}])


def test_first_with_null_ordering(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 5)], "g string, x double, t int")
    out = agg.aggregate(df, ["g"], [{"column": "x", "agg": "first"}], order_by=["t"])
    assert out.first().x_first == 1.0  # a null ordering value sorts first


def test_global_and_booleans(spark):
    df = spark.createDataFrame([(True, 1), (False, 2), (True, None)], "b boolean, v int")
    out = agg.aggregate(df, [], [{"column": "b", "agg": "sum"}, {"column": "b", "agg": "any"}, {"column": "b", "agg": "all"},
                                 {"column": "v", "agg": "product"}, {"column": "v", "agg": "std"}, {"column": "v", "agg": "mode"}]).first()
    assert out.b_sum == 2 and out.b_any is True and out.b_all is False and out.v_product == 2.0


def test_unknown_metric_and_alias_clash(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, x double")
    with pytest.raises(ValueError, match="Unsupported metric"):
        agg.aggregate(df, ["g"], [{"column": "x", "agg": "histogram"}])
    with pytest.raises(ValueError, match="duplicate"):
        agg.aggregate(df, ["g"], [{"column": "x", "agg": "sum", "alias": "g"}])


def test_aggregate_multi(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 1)], "k string, v int")
    out = agg.aggregate_multi([a, b], "union", ["k"], [{"column": "v", "agg": "sum"}])
    assert {r.k: r.v_sum for r in out.collect()} == {"x": 1, "y": 2}
    out = agg.aggregate_multi([a, b], "union_all", ["k"], [{"column": "v", "agg": "sum"}])
    assert {r.k: r.v_sum for r in out.collect()} == {"x": 2, "y": 2}


def test_nan_rules(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (-0.0,), (0.0,)], "x double")
    out = agg.aggregate(df, [], [{"column": "x", "agg": "max"}, {"column": "x", "agg": "min"}, {"column": "x", "agg": "n_unique"}]).first()
    assert out.x_max != out.x_max  # NaN is largest in Spark
    assert out.x_min == 0.0 and out.x_n_unique == 3  # -0.0 and 0.0 group together
