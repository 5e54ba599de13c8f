"""Quarantine in one run of the plan, and database reads split by bounds that
the database finds."""
import random

import pytest
from pyspark.sql import functions as F

from table_data import SF_SMALL
from tablewright.operators import quality
from tablewright.plans import runner
from tablewright.sources import readers, sinks
from tablewright.sources.readers import JdbcOptions, read_jdbc

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_both_sides_come_from_one_run(spark):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(status):
        runs.add(1)
        return None if status == "O" else status

    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    df = orders.withColumn("error", seen("o_orderstatus"))
    valid, rejected, counts = quality.quarantine_once(df, "error")
    plain_valid, plain_rejected = quality.quarantine(df, "error")
    assert runs.value == orders.count()
    assert valid.columns == rejected.columns == df.columns
    assert counts == {"valid": valid.count(), "rejected": rejected.count()} and sum(counts.values()) == orders.count()
    for got, want in ((valid, plain_valid), (rejected, plain_rejected)):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for flag in (True, False):  # a side without rows
        sides = quality.quarantine_once(orders.withColumn("error", F.lit(flag)), "error")
        assert [x.count() for x in sides[:2]] == [0, orders.count()][:: 1 if flag else -1]


@pytest.mark.parametrize("single_pass", [True, False])
def test_quarantine_through_a_run(spark, tmp_path, single_pass):
    request = {
        "sources": [{"name": "o", "path": f"{SF_SMALL}/orders.parquet"}],
        "actions": [
            {"action": "action-filter-dataset", "name": "f", "input": ["o"], "config": {"condition": {"column": "o_totalprice", "op": "gt", "value": 100000}},
             "output": {"mode": "flag_column", "target_column": "dear"}},
            {"action": "action-error-quarantine", "name": "q", "input": ["f"],
             "config": {"error_column": "dear", "table": "x", "path": str(tmp_path / "bad"), "single_pass": single_pass}},
        ],
        "target": {"path": str(tmp_path / "good"), "write_mode": "overwrite", "create_if_missing": True},
    }
    rep = runner.run(spark, request)
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    dear = orders.where("o_totalprice > 100000").count()
    assert rep.side_writes == {"q": dear} and rep.rows_written == orders.count() - dear
    assert spark.read.parquet(str(tmp_path / "bad")).count() == dear


def test_reads_split_by_the_database(spark):
    """Bounds from aggregates of the database: several tasks of about equal
    rows on skewed values, nulls among them, each row once."""
    rnd = random.Random(3)
    url = "jdbc:derby:memory:twsplit;create=true"
    rows = [(i, None if i % 10 == 0 else int(rnd.paretovariate(0.8) * 10) % 100_000, float(i) / 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, k long, x double")
    sinks.write(df, jdbc={"url": url, "table": "APP.SPLIT", "properties": DERBY}, mode="overwrite", create_if_missing=True)
    for column, parts in (("i", 6), ("x", 4), ("k", 5)):
        got = read_jdbc(spark, JdbcOptions(url=url, table="APP.SPLIT", properties=DERBY, partition_column=column, num_partitions=parts))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))
        per_task = sorted(r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        if column != "k":
            assert len(per_task) == parts and max(per_task) < 1.2 * len(rows) / parts
        else:
            assert len(per_task) >= 2
    none = JdbcOptions(url=url, table="(SELECT * FROM APP.SPLIT WHERE \"i\" < 0) q", properties=DERBY, partition_column="i", num_partitions=3)
    assert read_jdbc(spark, none).count() == 0 and readers.split_points(spark, none) == []
    with pytest.raises(ValueError, match="num_partitions"):
        read_jdbc(spark, JdbcOptions(url=url, table="APP.SPLIT", properties=DERBY, partition_column="i"))
    with pytest.raises(ValueError, match="both"):
        read_jdbc(spark, JdbcOptions(url=url, table="APP.SPLIT", properties=DERBY, partition_column="i", num_partitions=2, lower_bound=0))


def test_a_request_splits_its_source(spark):
    url = "jdbc:derby:memory:twsplitreq;create=true"
    df = spark.range(500).select(F.col("id").cast("int").alias("N"), F.lit("a").alias("V"))
    sinks.write(df, jdbc={"url": url, "table": "APP.R", "properties": DERBY}, mode="overwrite", create_if_missing=True, options={"createTableColumnTypes": "V VARCHAR(3)"})
    source = {"name": "r", "type": "mysql", "connection": {"jdbc_url": url, "properties": DERBY},
              "dataset": {"schema": "APP", "table": "R", "partition_column": "N", "num_partitions": 4}}
    out = runner.build(spark, {"sources": [source], "actions": []}).final
    assert out.count() == 500 and out.rdd.getNumPartitions() == 5  # four ranges and the nulls


def test_split_predicates_are_disjoint_and_complete():
    parts = readers.split_predicates("c", [1.5, 4.0])
    assert parts == ["c < 1.5", "c >= 1.5 AND c < 4.0", "c >= 4.0", "c IS NULL"]
    assert readers.split_predicates("c", []) == ["1=1"]
