"""Streaming: row-local steps on a stream, quarantine and upsert sinks,
watermark de-duplication."""
from pyspark.sql import functions as F

from table_data import SF_SMALL
from tablewright.operators import rows
from tablewright.operators.mapping import map_target
from tablewright.streaming import streams


def test_row_steps_on_a_stream(spark, tmp_path):
    src = streams.open_stream(spark, f"{SF_SMALL}/orders.parquet")
    s = rows.filter_rows(src, {"column": "o_orderstatus", "op": "eq", "value": "F"}, flag="is_final")
    s = rows.row_hash(s, ["o_orderkey", "o_orderstatus"])
    s = map_target(s, [{"target_column": "id", "source_column": "o_orderkey"}, {"target_column": "h", "source_column": "row_hash"},
                       {"target_column": "f", "source_column": "is_final"}])
    q = s.writeStream.format("memory").queryName("tw_rows").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM tw_rows")
    batch = rows.row_hash(spark.read.parquet(f"{SF_SMALL}/orders.parquet"), ["o_orderkey", "o_orderstatus"])
    assert out.count() == batch.count()
    assert out.join(batch, (out.id == batch.o_orderkey) & (out.h == batch.row_hash)).count() == batch.count()


def test_quarantine_stream(spark, tmp_path):
    src = streams.open_stream(spark, f"{SF_SMALL}/orders.parquet").withColumn(
        "err", F.when(F.col("o_orderstatus") == "P", F.lit("PENDING"))
    )
    q = streams.quarantine_stream(src, "err", str(tmp_path / "valid"), str(tmp_path / "bad"), checkpoint=str(tmp_path / "ck"), trigger_once=True)
    q.awaitTermination(120)
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    assert spark.read.parquet(str(tmp_path / "bad")).count() == orders.filter("o_orderstatus = 'P'").count()
    assert spark.read.parquet(str(tmp_path / "valid")).count() == orders.filter("o_orderstatus <> 'P'").count()


def test_upsert_stream(spark, tmp_path):
    target = str(tmp_path / "target")
    spark.createDataFrame([(1, "old"), (99, "keep")], "k bigint, v string").write.parquet(target)
    inbox = str(tmp_path / "inbox")
    spark.createDataFrame([(1, "new", 2), (1, "older", 1), (5, "five", 1)], "k bigint, v string, t int").write.parquet(inbox)
    src = streams.open_stream(spark, inbox)
    q = streams.upsert_stream(src.select("k", "v", "t"), target, ["k"], order_by=["t"], checkpoint=str(tmp_path / "ck"), trigger_once=True)
    q.awaitTermination(120)
    got = sorted((r.k, r.v) for r in spark.read.parquet(target).collect())
    assert got == [(1, "new"), (5, "five"), (99, "keep")]


def test_dedup_stream(spark, tmp_path):
    src = streams.open_stream(spark, f"{SF_SMALL}/events.parquet")
    d = streams.dedup_stream(src, ["user_id", "event_type"], "ts", "1 hour")
    q = d.writeStream.format("memory").queryName("tw_dedup").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    n = spark.sql("SELECT * FROM tw_dedup").count()
    total = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    assert total.select("user_id", "event_type").distinct().count() <= n <= total.count()
