"""Structured Streaming versions of the steps that have side effects.

Row-local steps (filter / flag, row hash, format conversion, target
mapping, schema flag, exception flag) take a streaming DataFrame unchanged.
This module adds the parts that need a sink:

* ``open_stream``: a file source (Parquet by default) as a stream, with the
  schema taken from the existing files;
* ``quarantine_stream``: split each micro-batch into valid and rejected
  rows, two sinks;
* ``upsert_stream``: keyed merge of each micro-batch into a file dataset;
* ``dedup_stream``: drop repeated keys within a watermark.

Micro-batch writes go to ``<path>/batch_id=<n>`` with overwrite, so a batch
re-run after a failure replaces its own output instead of duplicating it;
the checkpoint location must be on shared storage.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import idents
from ..operators.quality import quarantine
from ..operators.rows import deduplicate
from ..sources.sinks import _fs, new_scratch_path, upsert_path


def open_stream(spark: SparkSession, path: str, *, format: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A file dataset as a stream.  A single file is opened as its folder
    filtered to that file name (the stream source watches folders)."""
    schema = spark.read.format(format).load(path).schema
    reader = spark.readStream.format(format).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    fs, p = _fs(spark, path)
    if fs.getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).load(p.getParent().toString())
    return reader.load(path)


def _checkpoint(spark: SparkSession, checkpoint: str | None, label: str) -> str:
    return checkpoint or new_scratch_path(spark, f"stream-{label}")


def quarantine_stream(
    stream: DataFrame,
    error_column: str,
    valid_path: str,
    rejected_path: str,
    *,
    checkpoint: str | None = None,
    include_valid_output: bool = True,
    format: str = "parquet",
    trigger_once: bool = False,
) -> StreamingQuery:
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        valid, rejected = quarantine(batch, error_column, include_valid_output)
        # both outputs are read from one cached micro-batch, not recomputed
        batch.persist()
        try:
            rejected.write.mode("overwrite").format(format).save(f"{rejected_path}/batch_id={batch_id}")
            if include_valid_output:
                valid.write.mode("overwrite").format(format).save(f"{valid_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", _checkpoint(stream.sparkSession, checkpoint, "quarantine"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def upsert_stream(
    stream: DataFrame,
    target_path: str,
    keys: Sequence[str],
    *,
    order_by: Sequence[str] | None = None,
    checkpoint: str | None = None,
    format: str = "parquet",
    trigger_once: bool = False,
) -> StreamingQuery:
    """Merge every micro-batch into ``target_path`` on ``keys``.  Within a
    batch the row that sorts last by ``order_by`` wins for a repeated key (no
    ``order_by``: repeated keys in a batch abort it)."""
    ks = idents(keys, what="keys")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        b = deduplicate(batch, ks, "last", order_by=order_by) if order_by else batch
        upsert_path(b, target_path, ks, format=format)

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", _checkpoint(stream.sparkSession, checkpoint, "upsert"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def dedup_stream(stream: DataFrame, subset: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Drop rows whose key was already seen, keeping state only as long as
    the watermark on ``event_time`` (``delay`` like ``"10 minutes"``) allows."""
    ks = idents(subset, what="subset")
    if isinstance(stream.schema[event_time].dataType, T.TimestampNTZType):
        # watermarks need TIMESTAMP; a zone-less time gets a session-zone copy
        marked = stream.withColumn("_tw_event_time", F.col(event_time).cast("timestamp"))
        return marked.withWatermark("_tw_event_time", delay).dropDuplicatesWithinWatermark(ks).drop("_tw_event_time")
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(ks)
