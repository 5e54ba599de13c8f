"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash over the last 32 bytes cuts a text wherever its top bits are zero,
so cut points move with the content and an insertion changes the chunks near
it only.  Chunks of ``MIN_BYTES`` to ``MAX_BYTES`` are compared by a 128-bit
digest; of every digest the first chunk (least id, then place) stays and the
others are removed, if they hold at least ``MIN_BYTES`` and stand in a run of
such chunks of at least ``MIN_RUN`` bytes, or make up the whole text.

A digest's chunks meet in one shuffle and are ranked by a streamed window, so
no group is held in memory.  Digests with more rows than an even share of a
task are found in a sample first, which decides their way only: their first
places come from partial aggregates, and their other chunks need no shuffle.
Texts are not shuffled.

Defined cases: a null or empty text has no chunks; repeated rows, and rows that
share an id, are documents of their own, of which one stays; null ids come last
in the order; other columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import stage

# A passage loses a part of a chunk at each end, and has to keep a run of
# MIN_RUN bytes: chunks are 44 bytes on average, so a few sentences are found.
MIN_BYTES = 12
MEAN_BITS = 5
MAX_BYTES = 512
MIN_RUN = 100
# hot digests are sought in one chunk of HOT_SAMPLE, where they occur HOT_LEAST times or more
HOT_SAMPLE = 64
HOT_LEAST = 16

# the gear table: one 32-bit word for each byte value, from a fixed seed
GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[byte i] modulo 2^32, for all i at once: sums
    over 1, 2, 4 ... 32 bytes are doubled."""
    h, width = GEAR[data], 1
    while width < 32:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width)) if width < len(h) else h[width:]
        width *= 2
    return h


def cuts(data: bytes, least: int = MIN_BYTES, bits: int = MEAN_BITS, most: int = MAX_BYTES) -> list[int]:
    """Ends of the chunks."""
    n, ends, start = len(data), [], 0
    marks = (np.flatnonzero(gear_hashes(np.frombuffer(data, np.uint8)) >> np.uint32(32 - bits) == 0) + 1).tolist() if n else []
    for m in marks:
        while m - start > most:
            start += most
            ends.append(start)
        if m - start >= least:
            ends.append(m)
            start = m
    while n - start > most:
        start += most
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_column(text: Column) -> Column:
    """Chunk starts (with the end of the text) and the halves of the 128-bit
    digests of a text's UTF-8 bytes."""

    @F.pandas_udf("starts array<int>, high array<long>, low array<long>")
    def chunks(texts: pd.Series) -> pd.DataFrame:
        from xxhash import xxh3_128_digest

        rows = []
        for t in texts:
            data = (t or "").encode()
            ends = cuts(data)
            at = [0, *ends] if ends else []
            halves = np.frombuffer(b"".join(xxh3_128_digest(data[a:b]) for a, b in zip(at, at[1:])), ">i8").astype(np.int64)
            rows.append((at, halves[::2], halves[1::2]))
        return pd.DataFrame(rows, columns=["starts", "high", "low"])

    return chunks(text)


def chunk_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, t`` (hash of the text), ``row`` (its number, fixed once the
    table is staged), ``starts, high`` and ``low`` of every row."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), chunk_column(F.col(text_col)).alias("c"))
    return docs.select("doc_id", "t", F.monotonically_increasing_id().alias("row"), "c.starts", "c.high", "c.low")


def hot_digests(one: DataFrame) -> DataFrame:
    """``high`` of the digests with over a task's even share of the sampled
    chunks: at most as many as there are shuffle partitions."""
    share = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stage(one.sample(1 / HOT_SAMPLE, seed=7).groupBy("high").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_LEAST), "hot-chunks")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where(F.col("n") > total / share).select("high")


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that are not the first of their digest: ``row, i`` (number of
    the chunk)."""
    one = chunks.select(
        "doc_id", "row", F.explode(F.expr("transform(high, (h, i) -> struct(i, h AS high, low[i] AS low, starts[i + 1] - starts[i] AS n))")).alias("c")
    ).select("doc_id", "row", "c.*").where(F.col("n") >= MIN_BYTES).drop("n")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "i")
    # at most one digest a shuffle partition, and a first place of each
    hot = _among(["high"], hot_digests(one))
    first = one.where(hot).groupBy("high", "low").agg(F.min(place).alias("first"))
    hot_gone = one.where(hot).where(~_among(["row", "i"], first.select("first.row", "first.i")))
    order = Window.partitionBy("high", "low").orderBy(F.asc_nulls_last("doc_id"), "row", "i")
    gone = one.where(~hot).withColumn("rank", F.row_number().over(order)).where("rank > 1")
    return gone.select("row", "i").union(hot_gone.select("row", "i"))


def _among(columns: list[str], rows: DataFrame) -> Column:
    """Whether whole numbers, none of them null, are among the few ``rows``."""
    found = [tuple(r) for r in rows.collect()]
    if not found:
        return F.lit(False)
    values = ", ".join(f"({', '.join(f'{x}L' for x in r)})" for r in found)
    return F.expr(f"({', '.join(f'CAST({c} AS BIGINT)' for c in columns)}) IN ({values})")


def joined_spans(starts: Column, gone: Column) -> Column:
    """Byte ranges of the chunks ``gone``, joined where they touch; ranges
    under ``MIN_RUN`` bytes stay, unless they are the whole text."""

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def spans(starts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for at, numbers in zip(starts, gone):
            if numbers is None or not len(numbers):
                out.append([])
                continue
            n = np.sort(np.asarray(numbers))
            new = np.flatnonzero(np.diff(n) > 1)
            first, last = n[np.r_[0, new + 1]], n[np.r_[new, len(n) - 1]]
            at = np.asarray(at)
            ranges = zip(at[first].tolist(), at[last + 1].tolist())
            out.append([{"s": s, "e": e} for s, e in ranges if e - s >= MIN_RUN or (s, e) == (0, at[-1])])
        return pd.Series(out, dtype=object)

    return spans(starts, gone)


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, t, n_bytes, n_chunks, n_removed`` and ``spans`` (sorted
    byte ranges to remove) for every row."""
    chunks = stage(chunk_table(documents, id_col, text_col), "chunks")
    # a row's chunk numbers are no more than its own chunk arrays hold
    gone = repeated_chunks(chunks).groupBy("row").agg(F.collect_list("i").alias("gone"))
    rows = chunks.select("row", "doc_id", "t", "starts", F.size("high").cast("long").alias("n_chunks"))
    rows = rows.join(gone, "row", "left")
    rows = rows.withColumn("spans", joined_spans(F.col("starts"), F.col("gone")))
    return rows.select(
        "doc_id", "t", F.coalesce(F.try_element_at("starts", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"), "n_chunks",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"]).alias("n_removed"), "spans",
    )


def cut_column(text: Column, spans: Column) -> Column:
    """The text's bytes without the spans."""

    @F.pandas_udf("binary")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for t, rs in zip(texts, ranges):
            data, end, keep = (t or "").encode(), 0, []
            for r in rs if rs is not None else ():
                keep.append(data[end : r["s"]])
                end = r["e"]
            out.append(b"".join([*keep, data[end:]]))
        return pd.Series(out, dtype=object)

    return cut(text, spans)
