"""Sources and sinks: Parquet pushdown, JDBC on embedded in-memory Derby (no
server, no port), staging, keyed merge, create_if_missing."""
import pytest
from pyspark.sql import functions as F

from table_data import SF_SMALL
from tablewright.sources import sinks
from tablewright.sources.readers import JdbcOptions, read_source

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def _plan(df):
    """The formatted physical plan, as ``df.explain("formatted")`` prints it."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_parquet_projection_and_filters_pushed(spark):
    df = read_source(spark, path=f"{SF_SMALL}/orders.parquet", columns=["o_orderkey", "o_totalprice"],
                     filters=[{"column": "o_orderstatus", "op": "eq", "value": "F"}, {"column": "o_totalprice", "op": "gt", "value": 1000}])
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_totalprice), EqualTo(o_orderstatus,F), GreaterThan(o_totalprice,1000.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    assert df.columns == ["o_orderkey", "o_totalprice"]


def test_source_limit_and_errors(spark):
    assert read_source(spark, path=f"{SF_SMALL}/orders.parquet", limit=7).count() == 7
    with pytest.raises(ValueError):
        read_source(spark)
    with pytest.raises(ValueError, match="leaf"):
        read_source(spark, path=f"{SF_SMALL}/orders.parquet", filters=[{"or": []}])
    with pytest.raises(ValueError, match="missing"):
        read_source(spark, path=f"{SF_SMALL}/orders.parquet", columns=["nope"])


def test_jdbc_roundtrip_partitioned(spark):
    url = "jdbc:derby:memory:twio;create=true"
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    target = {"url": url, "table": "APP.ORDERS_T", "properties": DERBY}
    with pytest.raises(ValueError, match="does not exist"):
        sinks.write(orders, jdbc=target, mode="append", create_if_missing=False)
    rep = sinks.write(orders, jdbc=target, mode="overwrite", create_if_missing=True, options={"createTableColumnTypes": "o_orderstatus VARCHAR(4)"})
    assert rep.rows_written == orders.count()
    opts = JdbcOptions(url=url, table="APP.ORDERS_T", properties=DERBY, partition_column="o_orderkey",
                       lower_bound=0, upper_bound=1500, num_partitions=4)
    src = read_source(spark, jdbc=opts, columns=["O_ORDERKEY", "O_TOTALPRICE"],
                      filters=[{"column": "O_ORDERSTATUS", "op": "eq", "value": "F"}])
    assert src.rdd.getNumPartitions() == 4
    plan = _plan(src)
    # the whole filter runs in the database: it is in the scan's WHERE, no Filter node is left
    assert "WHERE (\"o_orderstatus\" IS NOT NULL) AND (\"o_orderstatus\" = 'F')" in plan and "Filter (" not in plan
    assert "PushedFilters: [*IsNotNull(o_orderstatus), *EqualTo(o_orderstatus,F)]" in plan
    assert src.count() == orders.filter("o_orderstatus = 'F'").count()
    # append keeps the rows already there
    sinks.write(orders.limit(10), jdbc=target, mode="append", create_if_missing=True)
    assert read_source(spark, jdbc=opts).count() == orders.count() + 10


def test_write_modes_and_create_if_missing(spark, tmp_path):
    df = spark.range(5)
    p = str(tmp_path / "t")
    with pytest.raises(ValueError, match="does not exist"):
        sinks.write(df, path=p, mode="append", create_if_missing=False)
    assert sinks.write(df, path=p, mode="append", create_if_missing=True).rows_written == 5
    sinks.write(df, path=p, mode="append", create_if_missing=True)
    assert spark.read.parquet(p).count() == 10
    sinks.write(df, path=p, mode="overwrite", create_if_missing=True)
    assert spark.read.parquet(p).count() == 5
    with pytest.raises(ValueError):
        sinks.write(df, path=p, mode="upsert")


def test_merge_upsert(spark, tmp_path):
    p = str(tmp_path / "m")
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string").coalesce(1)  # one file, so all of it is rewritten
    sinks.write(base, path=p, mode="overwrite", create_if_missing=True)
    upd = spark.createDataFrame([(2, "B"), (3, "C")], "k bigint, v string")
    rep = sinks.write(upd, path=p, mode="merge", create_if_missing=True, merge_keys=["k"])
    assert rep.rows_written == 3
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [(1, "a"), (2, "B"), (3, "C")]
    dup = spark.createDataFrame([(4, "x"), (4, "y")], "k bigint, v string")
    with pytest.raises(Exception, match="duplicate or null keys"):
        sinks.write(dup, path=p, mode="merge", create_if_missing=True, merge_keys=["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [(1, "a"), (2, "B"), (3, "C")]
    fresh = str(tmp_path / "fresh")
    sinks.write(upd, path=fresh, mode="merge", create_if_missing=True, merge_keys=["k"])
    assert spark.read.parquet(fresh).count() == 2


def test_staging_cuts_lineage(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    staged = sinks.write_staging(df)
    assert staged.count() == 100
    plan = _plan(staged)
    assert "Scan parquet" in plan and "Range" not in plan
    assert sinks.scratch_dir(spark) == spark.sparkContext.getCheckpointDir().rstrip("/")


def test_scale_conf():
    from tablewright.session import scale_conf

    conf = scale_conf(100 * (1 << 40), 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert scale_conf(1 << 20, 8)["spark.sql.shuffle.partitions"] == "16"


def test_merge_into_catalog_table(spark):
    spark.sql("DROP TABLE IF EXISTS tw_merge_t")
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    sinks.write(base, table="tw_merge_t", mode="overwrite", create_if_missing=True)
    upd = spark.createDataFrame([(2, "B"), (3, "C")], "k bigint, v string")
    rep = sinks.write(upd, table="tw_merge_t", mode="merge", create_if_missing=True, merge_keys=["k"])
    assert rep.rows_written == 3
    assert sorted(tuple(r) for r in spark.table("tw_merge_t").collect()) == [(1, "a"), (2, "B"), (3, "C")]
    spark.sql("DROP TABLE tw_merge_t")


def test_jdbc_non_null_violation_leaves_target_untouched(spark):
    from tablewright.operators.mapping import map_target

    url = "jdbc:derby:memory:twnn;create=true"
    target = {"url": url, "table": "APP.NN", "properties": DERBY}
    good = spark.createDataFrame([(1,), (2,)], "id bigint")
    sinks.write(good, jdbc=target, mode="overwrite", create_if_missing=True)
    bad = map_target(spark.createDataFrame([(3,), (None,)], "id bigint"), [{"target_column": "id", "source_column": "id", "nullable": False}])
    with pytest.raises(Exception, match="non-nullable"):
        sinks.write(bad, jdbc=target, mode="append", create_if_missing=True)
    assert read_source(spark, jdbc=JdbcOptions(url=url, table="APP.NN", properties=DERBY)).count() == 2


def test_catalog_table_source(spark):
    spark.sql("DROP TABLE IF EXISTS tw_src_t")
    spark.range(10).withColumn("g", F.col("id") % 2).write.saveAsTable("tw_src_t")
    df = read_source(spark, table="tw_src_t", columns=["id"], filters=[{"column": "g", "op": "eq", "value": 1}])
    assert sorted(r.id for r in df.collect()) == [1, 3, 5, 7, 9]
    spark.sql("DROP TABLE tw_src_t")


def test_staging_to_catalog_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS tw_stage")
    out = sinks.write_staging(spark.range(6), table="tw_stage.t1")
    assert out.count() == 6 and spark.catalog.tableExists("tw_stage.t1")
    out = sinks.write_staging(spark.range(2), mode="append", table="tw_stage.t1")
    assert out.count() == 8
    spark.sql("DROP DATABASE tw_stage CASCADE")


def test_merge_recovers_refuses_nulls_and_keeps_the_layout(spark, tmp_path):
    import os

    p = str(tmp_path / "m")
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write(base, path=p, mode="append", create_if_missing=True)
    os.rename(p, p + ".__old-1")  # as a merge that died between its renames leaves it
    sinks.write(spark.createDataFrame([(2, "x")], "k int, v string"), path=p, mode="merge", merge_keys=["k"], create_if_missing=True)
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [(1, "a"), (2, "x")]
    with pytest.raises(ValueError, match="null keys"):
        sinks.write(spark.createDataFrame([(None, "x")], "k int, v string"), path=p, mode="merge", merge_keys=["k"])
    spark.sql("DROP TABLE IF EXISTS tw_layout")
    sinks.write(base.withColumn("p", base.k), table="tw_layout", mode="append", partition_by=["p"], create_if_missing=True)
    new = spark.createDataFrame([(2, "x", 2), (3, "c", 3)], "k int, v string, p int")
    sinks.write(new, table="tw_layout", mode="merge", merge_keys=["k"])
    assert sorted(tuple(r) for r in spark.table("tw_layout").collect()) == [(1, "a", 1), (2, "x", 2), (3, "c", 3)]
    assert any(r.col_name == "# Partition Information" for r in spark.sql("DESCRIBE tw_layout").collect())
    spark.sql("DROP TABLE tw_layout")
