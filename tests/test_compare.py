"""Comparisons: FIXTURES cases F18-F22 plus the null/tolerance matrix."""
import pytest

from tablewright.operators import compare


def _status(df, key, col):
    return {r[key]: r[col] for r in df.collect()}


def test_reconciliation(spark):  # F18
    src = spark.createDataFrame([(1, 100.0), (2, 50.0), (3, 75.0)], "payment_id bigint, amount double")
    tgt = spark.createDataFrame([(1, 100.0), (2, 999.0), (4, 1.0)], "payment_id bigint, amount double")
    out = compare.reconcile(src, tgt, ["payment_id"], ["amount"], 0.01)
    assert _status(out, "payment_id", "recon_status") == {
        1: "MATCHED", 2: "MISMATCHED", 3: "MISSING_IN_TARGET", 4: "MISSING_IN_SOURCE"
    }
    assert out.columns == ["payment_id", "amount", "amount_tgt", "recon_status"]


def test_reconciliation_custom_name(spark):  # F19
    src = spark.createDataFrame([(1, 100.0)], "payment_id bigint, amount double")
    out = compare.reconcile(src, src, ["payment_id"], ["amount"], 0.01, status_column="payment_recon_status")
    rows = out.collect()
    assert len(rows) == 1 and rows[0].payment_recon_status == "MATCHED" and "recon_status" not in out.columns


def test_delta(spark):  # F20
    old = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "customer_id bigint, balance bigint")
    new = spark.createDataFrame([(1, 10), (2, 999), (4, 40)], "customer_id bigint, balance bigint")
    out = compare.delta(old, new, ["customer_id"], ["balance"])
    assert _status(out, "customer_id", "change_type") == {1: "UNCHANGED", 2: "UPDATE", 3: "DELETE", 4: "INSERT"}


def test_snapshot(spark):  # F21
    d1 = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A")], "id bigint, status string")
    d2 = spark.createDataFrame([(1, "A"), (2, "B"), (4, "A")], "id bigint, status string")
    out = compare.snapshot_diff(d1, d2, ["id"], ["status"])
    assert _status(out, "id", "change_status") == {1: "UNCHANGED", 2: "CHANGED", 3: "REMOVED", 4: "ADDED"}


def test_cross_validate(spark):  # F22
    l = spark.createDataFrame([(1, 100.0), (2, 50.0)], "order_id bigint, order_total double")
    r = spark.createDataFrame([(1, 100.0), (2, 999.0)], "order_id bigint, payment_total double")
    out = compare.cross_validate(l, r, ["order_id"], [{"left_column": "order_total", "right_column": "payment_total", "op": "eq", "tolerance": 0.01}])
    assert _status(out, "order_id", "validation_status") == {1: "PASS", 2: "FAIL"}


def test_cross_validate_ops_and_nulls(spark):
    l = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0)], "k bigint, a double")
    r = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 1.0)], "k bigint, a double")
    out = compare.cross_validate(l, r, ["k"], [{"left_column": "a", "right_column": "a_right", "op": "gt"}])
    assert _status(out, "k", "validation_status") == {1: "PASS", 2: "FAIL", 3: "FAIL"}
    with pytest.raises(ValueError, match="op"):
        compare.cross_validate(l, r, ["k"], [{"left_column": "a", "right_column": "a_right", "op": "like"}])
    with pytest.raises(ValueError):
        compare.cross_validate(l, r, ["k"], [])


def test_mismatch_null_matrix(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, None, None), (3, 1.0, "x"), (4, 1.0, "x"), (5, float("nan"), "x")], "k bigint, v double, s string")
    b = spark.createDataFrame([(1, 1.0, "x"), (2, None, None), (3, 1.4, "x"), (4, 1.6, "y"), (5, float("nan"), "x")], "k bigint, v double, s string")
    out = _status(compare.reconcile(a, b, ["k"], ["v", "s"], 0.5), "k", "recon_status")
    assert out == {1: "MISMATCHED", 2: "MATCHED", 3: "MATCHED", 4: "MISMATCHED", 5: "MATCHED"}
    exact = _status(compare.reconcile(a, b, ["k"], ["v"]), "k", "recon_status")
    assert exact[3] == "MISMATCHED" and exact[2] == "MATCHED"


def test_no_compare_columns_never_differs(spark):
    a = spark.createDataFrame([(1, 1)], "k bigint, v bigint")
    b = spark.createDataFrame([(1, 2)], "k bigint, v bigint")
    assert compare.reconcile(a, b, ["k"]).first().recon_status == "MATCHED"


def test_null_keys_show_from_each_side(spark):
    a = spark.createDataFrame([(None, 1)], "k bigint, v bigint")
    out = compare.reconcile(a, a, ["k"], ["v"]).collect()
    assert sorted(r.recon_status for r in out) == ["MISSING_IN_SOURCE", "MISSING_IN_TARGET"]


def test_counts_add_up(spark):
    a = spark.range(0, 100).selectExpr("id", "1.0D AS v")
    b = spark.range(50, 130).selectExpr("id", "1.0D AS v")
    out = compare.reconcile(a, b, ["id"], ["v"])
    counts = {r.recon_status: r["count"] for r in out.groupBy("recon_status").count().collect()}
    assert sum(counts.values()) == 100 + 80 - counts["MATCHED"]


def test_missing_compare_column_named(spark):
    a = spark.createDataFrame([(1, 1)], "k bigint, v bigint")
    b = spark.createDataFrame([(1,)], "k bigint")
    with pytest.raises(ValueError, match="second input is missing columns"):
        compare.reconcile(a, b, ["k"], ["v"])


def test_duplicate_keys_rule(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "k bigint, v bigint")
    b = spark.createDataFrame([(1, 1)], "k bigint, v bigint")
    assert compare.reconcile(a, b, ["k"], ["v"]).count() == 2  # allowed: rows multiply
    with pytest.raises(ValueError, match="duplicate keys"):
        compare.reconcile(a, b, ["k"], ["v"], on_duplicate_keys="error")
    assert compare.delta(b, b, ["k"], ["v"], on_duplicate_keys="error").count() == 1


def test_compared_columns_only(spark):
    a = spark.createDataFrame([(1, 1, "x")], "k bigint, v bigint, other string")
    b = spark.createDataFrame([(1, 2, "y")], "k bigint, v bigint, other string")
    out = compare.reconcile(a, b, ["k"], ["v"], columns="compared")
    assert out.columns == ["k", "v", "v_tgt", "recon_status"] and out.first().recon_status == "MISMATCHED"


def test_bucketed_tables_compare_without_shuffle(spark):
    from tablewright.sources import sinks

    for t in ("tw_b1", "tw_b2"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_totalprice")
    sinks.write(o, table="tw_b1", mode="overwrite", create_if_missing=True, bucket_by=(4, ["o_orderkey"]))
    sinks.write(o.withColumn("o_totalprice", o.o_totalprice + 1), table="tw_b2", mode="overwrite", create_if_missing=True, bucket_by=(4, ["o_orderkey"]))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too big to broadcast
    try:
        out = compare.reconcile(spark.table("tw_b1"), spark.table("tw_b2"), ["o_orderkey"], ["o_totalprice"], 0.5)
        plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
        # no shuffle: the bucketed tables are already partitioned on the key
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan
        assert out.filter("recon_status = 'MISMATCHED'").count() == o.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    for t in ("tw_b1", "tw_b2"):
        spark.sql(f"DROP TABLE {t}")


def test_key_as_compare_column_refused(spark):
    a = spark.createDataFrame([(1, 1)], "k bigint, v bigint")
    with pytest.raises(ValueError, match="keys cannot"):
        compare.reconcile(a, a, ["k"], ["k"])


def test_cross_validate_duplicate_rule(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k bigint, v double")
    b = spark.createDataFrame([(1, 1.0)], "k bigint, w double")
    rules = [{"left_column": "v", "right_column": "w"}]
    assert compare.cross_validate(a, b, ["k"], rules).count() == 2
    with pytest.raises(ValueError, match="duplicate keys"):
        compare.cross_validate(a, b, ["k"], rules, on_duplicate_keys="error")
