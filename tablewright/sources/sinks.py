"""Sinks: append / overwrite / keyed merge to Parquet paths, catalog tables
or JDBC; staging writes that cut lineage; quarantine writes.

Rows written are counted with an ``Observation`` on the write job itself,
so no second pass over the data is needed for the report.
"""
from __future__ import annotations

import time
import re
import uuid
from functools import reduce
from operator import or_
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.names import field_type, idents, require_columns
from ..session import ensure_checkpoint_dir
from . import merges

WRITE_MODES = ("append", "overwrite", "merge")


@dataclass
class WriteReport:
    target: str
    mode: str
    rows_written: int | None
    columns: list[str]


def observed_rows(obs: Observation, wait_s: float = 30.0) -> int | None:
    """Row count from an observation after its action ran.  The metrics
    arrive through the listener bus shortly after the job ends, so this waits
    up to ``wait_s``; ``None`` when the observed plan never ran (Catalyst may
    fold a node away entirely), instead of blocking forever."""
    jo = getattr(obs, "_jo", None)
    if jo is None:
        return None
    deadline = time.monotonic() + wait_s
    while not jo.future().isCompleted():
        if time.monotonic() > deadline:
            return None
        time.sleep(0.02)
    return int(obs.get.get("rows", 0))


# ---------------------------------------------------------------- paths


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and must be shared storage.
    Only when it is unset (local tests) a fresh local folder is made.
    """
    return ensure_checkpoint_dir(spark).rstrip("/")


def new_scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- write


def _target_exists(spark: SparkSession, path: str | None, table: str | None, jdbc: Mapping | None) -> bool:
    if path is not None:
        return path_exists(spark, path)
    if table is not None:
        return spark.catalog.tableExists(table)
    try:
        spark.read.jdbc(jdbc["url"], f"(SELECT 1 AS one FROM {jdbc['table']} WHERE 1=0) t", properties=dict(jdbc.get("properties", {}))).schema
        return True
    except Exception as e:
        if _MISSING_TABLE.search(str(e)):
            return False
        raise  # a refused connection or login says nothing about the table


# How databases say that a table or its schema is not there.
_MISSING_TABLE = re.compile(
    r"does not exist|doesn't exist|not found|no such table|invalid object name|unknown table|42X05|42Y07|42P01|42S02|ORA-00942", re.I
)


def _shown(jdbc: Mapping) -> str:
    """The JDBC target without credentials or parameters."""
    url = re.sub(r"//[^/@]*@", "//", re.split(r"[;?]", jdbc["url"], maxsplit=1)[0])
    return f"{url}::{jdbc['table']}"


def write(
    df: DataFrame,
    *,
    path: str | None = None,
    table: str | None = None,
    jdbc: Mapping | None = None,
    format: str = "parquet",
    mode: str = "append",
    merge_keys: Sequence[str] | None = None,
    create_if_missing: bool = False,
    partition_by: Sequence[str] | None = None,
    options: Mapping[str, str] | None = None,
    stage_jdbc: bool = True,
    bucket_by: tuple[int, Sequence[str]] | None = None,
) -> WriteReport:
    """Write ``df`` to exactly one target and report the rows written.

    File and table writes commit only when every task succeeded.  A JDBC
    write commits per task, so by default the data is first written to the
    shared scratch folder and copied from there (``stage_jdbc``).

    ``bucket_by=(n, keys)`` (catalog tables) stores the rows hash-bucketed
    and sorted on ``keys``: later joins, comparisons and aggregations on those
    keys between tables with the same bucket count read co-located data and
    skip the shuffle.
    """
    spark = df.sparkSession
    if mode not in WRITE_MODES:
        raise ValueError(f"write mode must be one of {WRITE_MODES}, not {mode!r}")
    given = [x for x in (path, table, jdbc) if x is not None]
    if len(given) != 1:
        raise ValueError("a sink needs exactly one of path, table, jdbc")
    name = path or table or _shown(jdbc)
    exists = _target_exists(spark, path, table, jdbc)
    if not exists and not create_if_missing:
        raise ValueError(f"target {name} does not exist and create_if_missing is false")
    if mode == "merge":
        keys = idents(merge_keys or [], what="merge_keys")
        require_columns(df, keys, where="merge input")
        if path is not None:
            return upsert_path(df, path, keys, format=format, partition_by=partition_by)
        if table is not None:
            return upsert_table(df, table, keys)
        return upsert_jdbc(df, jdbc, keys)
    if jdbc is not None and stage_jdbc:
        # run the whole plan (and its in-plan checks) into the shared scratch
        # folder first, so a failing job never leaves a partial database write
        df = write_staging(df)
    obs = Observation(f"tw_write_{uuid.uuid4().hex[:8]}")
    counted = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    if jdbc is not None:
        props = dict(jdbc.get("properties", {}))
        w = counted.write.mode(mode).options(**dict(options or {}))
        if mode == "overwrite":
            w = w.option("truncate", "true")  # keep the target's DDL
        w.jdbc(jdbc["url"], jdbc["table"], properties=props)
    else:
        w = counted.write.mode(mode).format(format).options(**dict(options or {}))
        if partition_by:
            w = w.partitionBy(*partition_by)
        if bucket_by is not None:
            if table is None:
                raise ValueError("bucket_by needs a catalog table target")
            n, bkeys = bucket_by
            w = w.bucketBy(int(n), *bkeys).sortBy(*bkeys)
        if table is not None:
            w.saveAsTable(table)
        else:
            w.save(path)
    return WriteReport(name, mode, observed_rows(obs), list(df.columns))


def upsert_path(
    df: DataFrame, path: str, keys: Sequence[str], *, format: str = "parquet", partition_by: Sequence[str] | None = None
) -> WriteReport:
    """Keyed merge into a file dataset: target rows whose key is absent from
    ``df`` are kept, every ``df`` row is written (update + insert).

    Only files that hold a matched key are rewritten (``merges``); the rest
    stay as they are.  New files are ranged by key, so that a later merge of
    neighbouring keys touches few of them.  Where ``df`` brings columns that
    the target lacks, or the target's partition folders are not those asked
    for, all files are rewritten.  Keys in ``df`` must be unique; a duplicate
    is refused before anything is written.  The report counts the rows that
    were written: those of the rewritten files and of ``df``.
    """
    spark = df.sparkSession
    keys = list(keys)
    _recover(spark, path)
    merges.settle(spark, path)
    checked = _checked_source(df, keys)
    folder = merges.Folder(spark, path)
    present = folder.files() if folder.exists() else []
    if not present:
        return write(checked, path=path, format=format, mode="append", create_if_missing=True, partition_by=partition_by)
    target = spark.read.format(format).load(path)
    require_columns(target, keys, where="merge target")
    known = {c.lower() for c in target.columns}
    asked = [c.lower() for c in partition_by or []]
    layout = [part.split("=", 1)[0] for part in present[0].split("/")[:-1]]  # k=v folders
    if all(c.lower() in known for c in checked.columns) and (not asked or asked == [c.lower() for c in layout]):
        replaced, partition_by = merges.touched_files(target, checked, keys, folder), layout
    else:
        replaced, partition_by = present, partition_by or layout
    held = merges.read_files(spark, folder, replaced, format, target.schema) if replaced else target.limit(0)
    merged = held.join(checked.select(*keys), keys, "left_anti").unionByName(checked, allowMissingColumns=True)
    merged = merged.repartitionByRange(max(1, len(replaced)), *keys) if len(replaced) < len(present) else merged
    hidden = f"_merge-{uuid.uuid4().hex}"
    obs = Observation(f"tw_merge_{uuid.uuid4().hex[:8]}")
    w = merged.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").format(format)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(f"{folder.path}/{hidden}")
    merges.commit(folder, hidden, replaced)
    merges.settle(spark, path)
    return WriteReport(path, "merge", observed_rows(obs), list(merged.columns))


def _recover(spark: SparkSession, path: str) -> None:
    """A merge that died between its two renames left the target under its
    aside name: put it back before anything else looks for it."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return
    aside = fs.globStatus(_fs(spark, f"{path.rstrip('/')}.__old-*")[1]) or []
    if len(aside) > 1:
        raise RuntimeError(f"several unfinished merges of {path}: keep one of its .__old- folders")
    if len(aside) == 1 and not fs.rename(aside[0].getPath(), p):
        raise RuntimeError(f"could not put {path} back after an unfinished merge")


def _checked_source(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The merge source, staged once so that the check and the write see the
    same rows.  A repeated key (the merge would be ambiguous) or a null in a
    key (it would match nothing and be added again by every retry) is refused.
    One aggregate over the key columns, counted partially on every map task;
    at most one row reaches the driver."""
    df = write_staging(df)
    null = reduce(or_, [F.col(k).isNull() for k in keys])
    bad = df.groupBy(*keys).count().filter((F.col("count") > 1) | null).limit(1).collect()
    if bad:
        raise ValueError(f"merge source has duplicate or null keys, e.g. {bad[0].asDict()}")
    return df


def upsert_table(df: DataFrame, table: str, keys: Sequence[str]) -> WriteReport:
    """Keyed merge into a catalog table of any file format: the merged result
    is staged in the shared scratch folder (cutting the read of the table out
    of the lineage), then the table is overwritten from the staged copy."""
    spark = df.sparkSession
    keys = list(keys)
    checked = _checked_source(df, keys)
    if spark.catalog.tableExists(table):
        current = spark.table(table)
        merged = current.join(checked.select(*keys), keys, "left_anti").unionByName(checked, allowMissingColumns=True)
        extra = [c for c in merged.columns if c not in current.columns]
        if extra:
            raise ValueError(f"columns {extra} are not in table {table}")
        merged = merged.select(*current.columns)
    else:
        merged = checked
    staged = write_staging(merged)
    obs = Observation(f"tw_merge_{uuid.uuid4().hex[:8]}")
    counted = staged.observe(obs, F.count(F.lit(1)).alias("rows"))
    if spark.catalog.tableExists(table):
        counted.write.insertInto(table, overwrite=True)  # keeps the table's format, partitions and buckets
    else:
        counted.write.saveAsTable(table)
    return WriteReport(table, "merge", observed_rows(obs), list(merged.columns))


def upsert_jdbc(df: DataFrame, jdbc: Mapping, keys: Sequence[str]) -> WriteReport:
    """Keyed merge into a database table.  The tasks write the source to a
    table of its own beside the target; then the database itself, in one
    transaction, deletes the target rows whose keys are in it and inserts its
    rows.  A failure at any point leaves the target as it was.  Only standard
    SQL is used; the target's columns are those of ``df`` by name."""
    spark = df.sparkSession
    checked = _checked_source(df, keys)
    props = dict(jdbc.get("properties", {}))
    if not _target_exists(spark, None, None, jdbc):
        return write(checked, jdbc=jdbc, mode="append", create_if_missing=True, stage_jdbc=False)
    current = spark.read.jdbc(jdbc["url"], jdbc["table"], properties=props)
    require_columns(checked, keys, where="merge input")
    spelled = {c.lower(): c for c in current.columns}
    extra = [c for c in checked.columns if c.lower() not in spelled]
    if extra:
        raise ValueError(f"columns {extra} are not in table {jdbc['table']}")
    checked = checked.select(*[F.col(c).cast(field_type(current, spelled[c.lower()])).alias(spelled[c.lower()]) for c in checked.columns])
    schema, dot, _ = jdbc["table"].rpartition(".")
    aside = f"{schema}{dot}TW_MERGE_{uuid.uuid4().hex[:16].upper()}"
    obs = Observation(f"tw_merge_{uuid.uuid4().hex[:8]}")
    quote = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(jdbc["url"]).quoteIdentifier
    cols = ", ".join(map(quote, checked.columns))
    same = " AND ".join(f"s.{k} = {jdbc['table']}.{k}" for k in (quote(spelled[k.lower()]) for k in keys))
    like = f"CREATE TABLE {aside} AS SELECT {cols} FROM {jdbc['table']} WHERE 1=0"
    _first_that_runs(spark, jdbc, [like, like + " WITH NO DATA"])  # not all databases know the same form
    try:
        checked.observe(obs, F.count(F.lit(1)).alias("rows")).write.jdbc(jdbc["url"], aside, mode="append", properties=props)
        _run_sql(spark, jdbc, [
            f"DELETE FROM {jdbc['table']} WHERE EXISTS (SELECT 1 FROM {aside} s WHERE {same})",
            f"INSERT INTO {jdbc['table']} ({cols}) SELECT {cols} FROM {aside}",
        ])
    finally:
        _run_sql(spark, jdbc, [f"DROP TABLE {aside}"])
    return WriteReport(_shown(jdbc), "merge", observed_rows(obs), list(checked.columns))


def _run_sql(spark: SparkSession, jdbc: Mapping, statements: Sequence[str]) -> None:
    """Statements in one transaction of the database, from the driver."""
    jvm, props = spark.sparkContext._jvm, jdbc.get("properties", {})
    if "driver" in props:
        jvm.java.lang.Class.forName(props["driver"])
    given = jvm.java.util.Properties()
    for k, v in props.items():
        given.setProperty(k, str(v))
    db = jvm.java.sql.DriverManager.getConnection(jdbc["url"], given)
    try:
        db.setAutoCommit(False)
        for text in statements:
            db.createStatement().executeUpdate(text)
        db.commit()
    except Exception:
        db.rollback()
        raise
    finally:
        db.close()


def _first_that_runs(spark: SparkSession, jdbc: Mapping, forms: Sequence[str]) -> None:
    for i, text in enumerate(forms):
        try:
            return _run_sql(spark, jdbc, [text])
        except Exception:
            if i == len(forms) - 1:
                raise


def write_staging(
    df: DataFrame, path: str | None = None, mode: str = "overwrite", *, format: str = "parquet", table: str | None = None
) -> DataFrame:
    """Write ``df`` and return a DataFrame reading the written copy: lineage is
    cut here and later steps (and retries after a lost executor) start from
    the files.  Target: ``path``, or a catalog ``table``, or by default a
    fresh folder under the shared ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    if mode not in ("overwrite", "append"):
        raise ValueError("staging mode must be overwrite or append")
    if table is not None and path is None:
        df.write.mode(mode).format(format).saveAsTable(table)
        return spark.table(table)
    target = path or new_scratch_path(spark, "staging")
    df.write.mode(mode).format(format).save(target)
    return spark.read.format(format).load(target)


def write_quarantine(rejected: DataFrame, **target) -> WriteReport:
    """Persist rejected rows (append by default, to a new target if need be)."""
    target.setdefault("mode", "append")
    target.setdefault("create_if_missing", True)
    return write(rejected, **target)
