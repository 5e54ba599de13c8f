"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has a bit set where more than half of its shingles'
hashes have it set.  Equal fingerprints are merged first, so groups of copies
are one row.  Distinct fingerprints within ``radius`` bits agree on some
``m`` of ``radius + m`` bit blocks; each choice of m blocks is a lookup key,
and fingerprints that share a key are compared.  ``m`` grows with the number
of fingerprints, so that a key is expected to hold at most
``EXPECTED_BUCKET`` of them; no link is lost for any m.

Inside a bucket the comparison is bit-sliced: bit plane p holds bit p of 64
fingerprints in one word; a query's differing bits are added to vertical
counters by carry-save steps, and words whose 64 counters all exceed the
radius are abandoned.  Buckets over ``BUCKET_ROWS`` are split into chunks and
compared pair of chunks by pair of chunks in separate groups.  A bucket
returns a spanning forest of its links, and the components of all forests are
found by star steps.

Defined cases: a null or empty text has fingerprint zero and links like any
other; a null id gets its component's least id (null if there is none);
repeated rows are returned each; other columns are ignored; an empty table
gives no rows.
"""
from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import small, stage
from tablewright.llm.components import components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BITS = 64

EXPECTED_BUCKET = 4096
BUCKET_ROWS = 8192
GROUP_ROWS = 20_000

_HASHES_AT_ONCE = 1 << 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of a text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    counts, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _HASHES_AT_ONCE):
        spans = zip(starts[at : at + _HASHES_AT_ONCE], ends[at : at + _HASHES_AT_ONCE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a (signed) long column."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return fp(text)


def to_hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


# --- comparison inside a bucket -------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) uint64: plane p holds bit p of each fingerprint, 64 to a
    word; missing lanes of the last word are zero."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    bits = np.pad(bits.T, ((0, 0), (0, -len(fps) % 64)))
    return np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").view("<u8")


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    more, equal = over.copy(), np.full_like(over, _ALL)
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            more |= equal & counters[i]
            equal &= ~counters[i]
    return more


def near_words(planes: np.ndarray, queries: np.ndarray, first: np.ndarray, radius: int):
    """Compare each query with the words from ``first`` (per query) on.
    Yields arrays (query index, word index, lanes within the radius)."""
    n_words = planes.shape[1]
    q = np.repeat(np.arange(len(queries)), n_words - first)
    w = np.concatenate([np.arange(f, n_words) for f in first]) if len(first) else np.zeros(0, int)
    counters = [np.zeros(len(q), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(q), np.uint64)
    flips = [np.where(queries >> np.uint64(p) & np.uint64(1), _ALL, np.uint64(0)) for p in range(BITS)]
    for p in range(BITS):
        carry = planes[p, w] ^ flips[p][q]
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over |= carry
        if p % 8 == 7 and p >= 15:
            alive = _exceeds(counters, over, radius) != _ALL
            if alive.mean() < 0.7 if len(alive) else False:
                q, w, over = q[alive], w[alive], over[alive]
                counters = [c[alive] for c in counters]
    lanes = ~_exceeds(counters, over, radius)
    hit = lanes != 0
    return q[hit], w[hit], lanes[hit]


def bucket_forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest (fingerprint, root) of the links among distinct
    ``fps``."""
    n = len(fps)
    if n < 2:
        return []
    planes, label = bit_planes(fps), np.arange(n)
    step = max(1, min(1024, (1 << 17) // planes.shape[1]))
    for at in range(0, n, step):
        block = fps[at : at + step]
        q, w, lanes = near_words(planes, block, (at + np.arange(len(block))) // 64, radius)
        if len(q) <= len(block) and not (lanes & (lanes - np.uint64(1))).any():
            continue  # each met itself only
        bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(bits)
        one, other = at + q[row], w[row] * 64 + lane
        keep = (other > one) & (other < n)
        one, other = one[keep], other[keep]
        cuts = np.flatnonzero(np.diff(one, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(one)]):
            met, own = label[other[a:b]], label[one[a]]
            if (met != own).any():
                labels = np.unique(np.append(met, own))
                label[np.isin(label, labels)] = labels[0]
    roots = fps[label]
    return [(int(f), int(r)) for f, r in zip(fps[label != np.arange(n)], roots[label != np.arange(n)])]


# --- candidate keys --------------------------------------------------------


def key_plan(n: int, radius: int = RADIUS) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Bit blocks (offset, width) and the choices of blocks used as keys for
    ``n`` fingerprints."""
    m = 1
    while n > EXPECTED_BUCKET << (BITS * m // (radius + m)) and radius + m < 16:
        m += 1
    cuts = [BITS * i // (radius + m) for i in range(radius + m + 1)]
    blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return blocks, list(itertools.combinations(range(radius + m), m))


def _key(blocks: list[tuple[int, int]], chosen: tuple[int, ...]) -> Column:
    mask = sum(((1 << blocks[c][1]) - 1) << blocks[c][0] for c in chosen)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def fingerprint_links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the distinct
    fingerprints ``fp`` within ``radius``."""
    spark = distinct.sparkSession
    blocks, choices = key_plan(n, radius)
    keyed = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), _key(blocks, c).alias("k")) for i, c in enumerate(choices)])).alias("x")
    ).select("fp", "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("c")).where("c > 1")
    keyed = keyed.join(sizes, ["t", "k"]).withColumn("nb", F.ceil(F.col("c") / BUCKET_ROWS).cast("int"))
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    keyed = keyed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(shuffle, n * len(choices) // GROUP_ROWS)
    keyed = keyed.withColumn("g", F.pmod(F.xxhash64("t", "k", "i", "j"), F.lit(groups)))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "k", "i", "j", "fp"])
        same = (rows[["t", "k", "i", "j"]].to_numpy()[1:] == rows[["t", "k", "i", "j"]].to_numpy()[:-1]).all(1)
        cuts = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(rows)]))
        fps, out = rows["fp"].to_numpy().view(np.uint64), []
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                out += bucket_forest(fps[a:b], radius)
        return pd.DataFrame(np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return keyed.select("g", "t", "k", "i", "j", "fp").groupBy("g").applyInPandas(compare, "a long, b long")


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """``doc_id, fp`` (signed long), ``component_id`` for every row."""
    docs = documents.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp"))
    docs = stage(docs, "simhash-docs")
    distinct = stage(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    linked = components(fingerprint_links(distinct.select("fp"), distinct.count(), radius), "simhash-links")
    member = distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = stage(member, "simhash-members")
    least = stage(member.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    member = stage(member.join(small(least), "root").select("fp", "component_id"), "simhash-classes")
    return docs.join(member, "fp").select("doc_id", "fp", "component_id")
