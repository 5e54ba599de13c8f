"""Exact substring dedup by distributed prefix doubling.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
at another place.  Ranks are names of equal strings: two positions have equal
ranks if and only if their strings of the present length are equal.

* Positions.  The starts p of a text are cut into runs; a run shares an anchor,
  the leftmost least 16-byte hash of the ``SPAN`` positions from p on.  Equal
  strings have equal anchors at equal distances, so places can only match
  through their runs' anchors, and sorting anchors stands for sorting all
  starts.
* Doubling.  Anchors are ranked by their first ``BASE`` bytes; anchors of
  unique rank drop out.  The rest are ranked by the pair (rank, rank at offset
  ``BASE``, up to the last byte that the strings of all starts with this
  anchor share), again without the unique ones, and then past the threshold,
  with all the bytes that the run's strings cover.
* Runs of equal last rank are repeats as a whole.  Where runs of equal middle
  rank differ in the last one, a representative of each is cut into parts of
  ``PART`` starts, ranked in the same two ways, and at last into single starts.

Counting is partially aggregated, so the copies of a passage are counted
before they meet; joins of ranks with their counts have one row for a rank on
one side.  Names are 64-bit hashes; the later rounds' keys combine two or three
of them.

Defined cases: a null or empty text keeps nothing and loses nothing; texts
shorter than ``LENGTH`` lose nothing; repeated rows are places of their own,
so both lose what they share; other columns are ignored; an empty table gives
no rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.cdc_dedup import cut_column
from tablewright.llm.common import small, stage

LENGTH = 200
SPAN = 128
GRAM = 16
BASE = 36
PART = 16

_SLICE = 1 << 20
_TABLE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 40-bit hash of the 16 bytes from every position on."""
    h, factor, width = _TABLE[data], _STEP, 1
    while width < GRAM:
        h = h[:-width] * factor + h[width:]
        with np.errstate(over="ignore"):
            factor = np.uint64((int(factor) * int(factor)) % (1 << 64))
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(24)


def runs(data: bytes, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(first start, last start, anchor) of every run; starts go from 0 to
    len(data) - length."""
    out: list[tuple[int, int, int]] = []
    starts = len(data) - length + 1
    for at in range(0, max(0, starts), _SLICE):
        here = min(_SLICE, starts - at)
        part = np.frombuffer(data, np.uint8, here + SPAN + GRAM - 2, at)
        least = _gram_hashes(part) << np.uint64(24) | np.arange(here + SPAN - 1, dtype=np.uint64)
        width = 1
        while width < SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], here) - 1
        out += zip((first + at).tolist(), (last + at).tolist(), (anchor[first] + at).tolist())
    return out


RUNS = "a array<int>, m array<int>, lo array<int>, r0 array<long>, r1 array<long>, r2 array<long>"


def _run_column(text: Column, length: int) -> Column:
    @F.pandas_udf(RUNS)
    def find(texts: pd.Series) -> pd.DataFrame:
        from xxhash import xxh3_64_intdigest as name

        def names(values: list[int]) -> np.ndarray:
            return np.array(values, dtype=np.uint64).view(np.int64)

        rows = []
        for t in texts:
            data = (t or "").encode()
            found = runs(data, length)
            rows.append((
                np.array([a for _, _, a in found], np.int32), np.array([b - f + 1 for f, b, _ in found], np.int32),
                np.array([f for f, _, _ in found], np.int32),
                names([name(data[a : a + BASE]) for _, _, a in found]), names([name(data[a + BASE : a + length - SPAN + 1]) for _, _, a in found]),
                names([name(data[f : b + length], seed=a - f) for f, b, a in found]),
            ))
        return pd.DataFrame(rows, columns=["a", "m", "lo", "r0", "r1", "r2"])

    return find(text)


def _part_column(text: Column, chosen: Column, length: int, size: int) -> Column:
    """The chosen runs of starts (a, s, m, w) cut into parts on a grid of
    ``size`` starts from the anchor, named by what all strings of the grid's
    cell share and by all that the part's strings cover."""

    @F.pandas_udf("s array<int>, m array<int>, r1 array<long>, r2 array<long>, w array<int>")
    def cut(texts: pd.Series, picks: pd.Series) -> pd.DataFrame:
        from xxhash import xxh3_64_intdigest as name

        rows = []
        for t, ps in zip(texts, picks):
            data = (t or "").encode()
            parts, shared = [], []
            for p in ps:
                at, end = p["s"], p["s"] + p["m"]
                while at < end:
                    cell = at - (at - p["a"]) % size
                    to = min(end, cell + size)
                    parts.append((at, to - at, p["w"]))
                    shared.append(name(data[cell + size - 1 : cell + length]))
                    at = to
            whole = [name(data[s : s + m - 1 + length], seed=m) for s, m, _ in parts]
            rows.append((
                [x[0] for x in parts], [x[1] for x in parts], np.array(shared, np.uint64).view(np.int64),
                np.array(whole, np.uint64).view(np.int64), [x[2] for x in parts],
            ))
        return pd.DataFrame(rows, columns=["s", "m", "r1", "r2", "w"])

    return cut(text, chosen)


def _not_unique(rows: DataFrame, ranks: list[str]) -> DataFrame:
    """One round: drop rows whose rank is unique.  Rows of a rank with more
    than an even task's share are dealt out by the task that reads them, and
    their rank is looked up once for each part."""
    shared = rows.groupBy(*ranks).agg(F.count("*").alias("c")).where("c > 1")
    shared = stage(shared, "shared-ranks")
    total = shared.agg(F.sum("c")).first()[0] or 0
    share = max(1, total // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = F.ceil(F.col("c") / F.lit(share)).cast("int")
    heavy = shared.where(F.col("c") > share).select(*ranks, parts.alias("parts"))
    dealt = rows.join(F.broadcast(heavy), ranks, "left")  # at most one row a shuffle partition
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.spark_partition_id(), F.col("parts")), F.lit(0))).drop("parts")
    shared = shared.select(*ranks, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(shared, [*ranks, "part"], "left_semi").select(rows.columns)


def repeated_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Byte ranges covered by repeated strings, which may overlap:
    ``doc_id, t`` (hash of the text), ``s, e``."""
    if length < SPAN + 2 * BASE:
        raise ValueError(f"length must be at least {SPAN + 2 * BASE}")
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    runs_of = docs.where(F.octet_length("text") >= length).select("doc_id", "t", _run_column(F.col("text"), length).alias("x"))
    one = runs_of.select("doc_id", "t", F.explode(F.arrays_zip("x.a", "x.lo", "x.m", "x.r0", "x.r1", "x.r2")).alias("x"))
    one = one.select("doc_id", "t", "x.a", F.col("x.lo").alias("s"), "x.m", "x.r0", "x.r1", "x.r2")
    units = stage(_not_unique(one, ["r0"]), "rank-base")
    units = stage(_not_unique(units, ["r0", "r1"]).withColumn("w", F.lit(1)), "rank-pairs")
    found = []
    for size in (PART, 1, 0):
        ranges, picks = _rank_whole(units, length)
        found.append(ranges)
        if size:
            picks = picks.groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "s", "m", "w")).alias("p"))
            picks = stage(picks, "rank-part").withColumnsRenamed({"doc_id": "d", "t": "u"})
            # a repeated row's runs all weigh two, so reading its text twice changes nothing
            texts = docs.join(small(picks), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")))
            units = texts.select("doc_id", "t", _part_column(F.col("text"), F.col("p"), length, size).alias("x"))
            units = units.select("doc_id", "t", F.explode(F.arrays_zip("x.s", "x.m", "x.r1", "x.r2", "x.w")).alias("x"))
            units = units.select("doc_id", "t", F.col("x.s").alias("a"), "x.s", "x.m", F.lit(0).cast("long").alias("r0"), "x.r1", "x.r2", "x.w")
            units = stage(units, "ranked-parts")
    return found[0].unionByName(found[1]).unionByName(found[2])


def _rank_whole(units: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Last round for runs of starts (``s``, ``m``) of weight ``w`` (2: known
    to repeat).  Returns the ranges of those that repeat as a whole, and
    representatives of runs that may repeat in part."""
    whole = units.groupBy("r0", "r1", "r2").agg(
        F.sum("w").alias("c"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "s", "m", "a")).alias("one")
    )
    whole = stage(whole, "rank-whole")
    same = whole.where("c > 1").select("r0", "r1", "r2")
    ranges = units.where("w = 1").join(same, ["r0", "r1", "r2"], "left_semi").select(
        "doc_id", "t", "s", (F.col("s") + F.col("m") - 1 + length).alias("e")
    )
    mixed = whole.groupBy("r0", "r1").agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 AND least = 1")
    picks = whole.join(mixed.select("r0", "r1"), ["r0", "r1"], "left_semi")
    return ranges, picks.select("one.*", F.least("c", F.lit(2)).cast("int").alias("w")).drop("none")


def merged(spans: DataFrame) -> DataFrame:
    """The union of a document's ranges as maximal ranges."""
    order = Window.partitionBy("doc_id", "t").orderBy("s")
    spans = spans.groupBy("doc_id", "t", "s").agg(F.max("e").alias("e"))
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(before >= F.col("s"), 0).otherwise(1))
    spans = spans.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "t", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, spans`` (maximal removed byte ranges, sorted) and
    ``kept`` (the remaining bytes) for every row."""
    spans = merged(repeated_spans(documents, id_col, text_col, length))
    spans = spans.groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    spans = stage(spans, "removed").withColumnsRenamed({"doc_id": "d", "t": "u"})
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("t"))
    docs = docs.join(small(spans), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")), "left")
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    return docs.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("spans", none).alias("spans"),
        F.when(F.col("spans").isNull(), F.col("text").cast("binary")).otherwise(cut_column(F.col("text"), F.coalesce("spans", none))).alias("kept"),
    )
