"""Keyed merge into a file dataset that rewrites touched files only.

A merge looks up which files hold a matched key (``_metadata.file_path``, read
with the key columns and the source's key range as pushed filter), writes
those files' surviving rows and the source rows as new files into a hidden
folder of the target, and carries all other files over as they are.  The
change is one small commit file, ``_merge-<id>.commit``: the files to remove
and the files to bring in.  Until it exists the target is what it was; once it
exists the merge holds, and ``settle`` carries it out, again and again if need
be: new files move into place, replaced ones go, the commit file goes last.

The target stays an ordinary folder of files at every moment.  ``live_files``
reads it rightly between the commit and its settling too, as ``read_source``
does; a plain reader may then see part of the change.  One merge at a time.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import field_type

_RANGED = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.DecimalType)


class Folder:
    """File system calls on one target folder; paths are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.jvm = spark.sparkContext._jvm
        at = self.jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        self.fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(at)
        self.path = path.rstrip("/")

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def exists(self, name: str = "") -> bool:
        return bool(self.fs.exists(self.at(name) if name else self.root))

    def names(self, prefix: str, suffix: str = "") -> list[str]:
        """Entries of the folder itself (none for a file, or a pattern)."""
        if not self.exists() or not self.fs.getFileStatus(self.root).isDirectory():
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(self.root)]
        return sorted(n for n in found if n.startswith(prefix) and n.endswith(suffix))

    def files(self, below: str = "") -> list[str]:
        """Data files, as Spark lists them (hidden names left out)."""
        top = self.at(below) if below else self.root
        it, out, start = self.fs.listFiles(top, True), [], len(top.toString()) + 1
        while it.hasNext():
            name = it.next().getPath().toString()[start:]
            if not any(part.startswith(("_", ".")) for part in name.split("/")):
                out.append(name)
        return sorted(out)

    def relative(self, uri: str) -> str:
        """A file's place in the folder from its ``_metadata.file_path``."""
        path, root = unquote(urlsplit(uri).path), self.root.toUri().getPath()
        if not path.startswith(root + "/"):
            raise ValueError(f"{uri} is not in {self.path}")
        return path[len(root) + 1 :]

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """All of the file or none: written aside, then renamed."""
        aside = f"_{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.at(aside), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.move(aside, name)

    def move(self, name: str, to: str) -> None:
        if not self.fs.rename(self.at(name), self.at(to)):
            raise RuntimeError(f"could not move {name} to {to} in {self.path}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _commits(folder: Folder) -> list[str]:
    return folder.names("_merge-", ".commit")


def settle(spark: SparkSession, path: str) -> None:
    """Carry out committed merges; remove what uncommitted ones left."""
    folder = Folder(spark, path)
    for commit in _commits(folder):
        todo = json.loads(folder.read_text(commit))
        for name in todo["bring"]:
            hidden = f"{todo['hidden']}/{name}"
            if folder.exists(hidden):
                folder.fs.mkdirs(folder.at(name).getParent())
                folder.move(hidden, name)
        for name in todo["remove"]:
            folder.remove(name)
        folder.remove(todo["hidden"])
        folder.remove(commit)
    for left in folder.names("_merge-"):
        folder.remove(left)


def live_files(spark: SparkSession, path: str) -> list[str] | None:
    """Paths of the target's files while a committed merge is not settled yet;
    None where the folder itself says all (nearly always)."""
    folder = Folder(spark, path)
    commits = _commits(folder)
    if not commits:
        return None
    files = {name: name for name in folder.files()}
    for commit in commits:
        todo = json.loads(folder.read_text(commit))
        for name in todo["bring"]:
            files.setdefault(name, f"{todo['hidden']}/{name}")
        for name in todo["remove"]:
            files.pop(name, None)
    return [f"{folder.path}/{files[name]}" for name in sorted(files)]


def touched_files(target: DataFrame, source: DataFrame, keys: Sequence[str], folder: Folder) -> list[str]:
    """Files of ``target`` that hold a key of ``source``."""
    ranged = [k for k in keys if isinstance(field_type(source, k), _RANGED) and type(field_type(source, k)) is type(field_type(target, k))]
    if ranged:  # row groups outside the source's key range are not read
        ends = source.agg(*[f(k).alias(f"{f.__name__}_{i}") for i, k in enumerate(ranged) for f in (F.min, F.max)]).first()
        for i, k in enumerate(ranged):
            if ends[f"min_{i}"] is not None:
                target = target.where(F.col(k).between(F.lit(ends[f"min_{i}"]), F.lit(ends[f"max_{i}"])))
    held = target.select(*keys, F.col("_metadata.file_path").alias("_tw_file"))
    hit = held.join(source.select(*keys), list(keys), "left_semi").select("_tw_file").distinct()
    return sorted(folder.relative(r[0]) for r in hit.collect())  # one row a file


def read_files(spark: SparkSession, folder: Folder, names: Sequence[str], format: str, schema: T.StructType) -> DataFrame:
    return spark.read.format(format).schema(schema).option("basePath", folder.path).load([f"{folder.path}/{n}" for n in names])


def commit(folder: Folder, hidden: str, replaced: Sequence[str]) -> None:
    """The one step that makes a merge hold."""
    todo = {"hidden": hidden, "bring": folder.files(hidden), "remove": list(replaced)}
    folder.write_text(f"{hidden}.commit", json.dumps(todo))
