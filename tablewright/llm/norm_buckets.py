"""Ranked lexical search over norm buckets (LEMP).

A document's impact vector holds, for every term that the queries use, its
impact times the root of the term's weight; a query's vector holds the term's
occurrences times that root, so their inner product is the score.  Impact
vectors are ordered by length, descending, over range partitions, and read in
buckets of ``BUCKET`` neighbours.  A bucket is pruned for a query if the
product of the lengths (Cauchy-Schwarz, with the bucket's longest vector) stays
below the query's k-th best score so far.  Inside a bucket the query's
``FOCUS`` largest coordinates are added up, and the rest is bounded by the
lengths of what remains of both vectors; documents whose bound falls below are
dropped.  The survivors are scored exactly in 64-bit integers.

The k-th best score starts from the longest vectors (``SEED_ROWS`` of them, by
an approximate quantile) and rises while a task reads its buckets; every task
returns its k best for each query, and these are merged.  Nothing is pruned
on a tie.

Queries are taken in blocks of about ``BLOCK_TERMS`` terms, the bound of what
is sent to the workers: a block's terms, its queries and their k-th scores.
Documents are read once for each block and never collected.

Defined cases: a null or empty text has no terms, and no item without terms
has an answer; items with a null id are answered, each row of a repeated item
by itself; repeated documents are ranked each, equal scores by ascending id,
null ids last; other columns are ignored; empty tables give no rows.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import ascii_lower, stage

K = 20
BUCKET = 2048
FOCUS = 6
SEED_ROWS = 8192
BLOCK_TERMS = 200_000

TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"

# the same terms in UTF-8 bytes, where lower() changes A-Z alone
_TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_AT_ONCE = 1 << 22
_SLACK = 1 + 1e-9


def count_terms(text: str | None) -> Counter:
    data = (text or "").encode().lower()
    if len(data) <= _AT_ONCE:
        return Counter(_TERM_BYTES.findall(data))
    return Counter(m.group() for m in _TERM_BYTES.finditer(data))


@dataclass
class Queries:
    """A block of queries: terms by number, and for every query the numbers
    and occurrences of its terms."""

    terms: dict[bytes, int]
    items: list[tuple[int, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows) -> Queries:
        terms: dict[bytes, int] = {}
        items = []
        for item, counts in rows:
            at = np.array([terms.setdefault(t, len(terms)) for t in counts], dtype=np.int64)
            items.append((item, at, np.array(list(counts.values()), dtype=np.int64)))
        return cls(terms, items)


def _count(terms: dict[bytes, int]):
    """Length of each document, and its counts of the queries' terms."""

    def run(batches):
        for rows in batches:
            out = {"n": [], "t": [], "f": []}
            for text in rows["text"]:
                counts = count_terms(text)
                held = sorted((terms[t], c) for t, c in counts.items() if t in terms)
                out["n"].append(sum(counts.values()))
                out["t"].append(np.array([t for t, _ in held], dtype="<i4").tobytes())
                out["f"].append(np.array([c for _, c in held], dtype="<i8").tobytes())
            yield pd.DataFrame({"row": rows["row"], "id": rows["id"], "none": rows["none"], **out})

    return run


def _document_counts(terms: dict[bytes, int]):
    """Documents that hold each term, added up over a task's rows."""

    def run(batches):
        total = np.zeros(len(terms), np.int64)
        for rows in batches:
            np.add.at(total, np.frombuffer(b"".join(rows["t"]), "<i4"), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "df": total[at]})

    return run


def impacts(counts: np.ndarray, n: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """The scale and constants of the ranking, in integers."""
    m = 100 - 25 + (25 * n * documents) // tokens
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def _vectors(weights: np.ndarray, documents: int, tokens: int):
    """Impact vectors (terms of positive weight) and their lengths."""

    def run(batches):
        for rows in batches:
            out = {"row": [], "id": [], "none": [], "norm": [], "t": [], "x": []}
            for row, i, none, n, t, f in zip(rows["row"], rows["id"], rows["none"], rows["n"], rows["t"], rows["f"]):
                t, f = np.frombuffer(t, "<i4"), np.frombuffer(f, "<i8")
                x = impacts(f, np.int64(n), documents, tokens)
                keep = (weights[t] > 0) & (x > 0)
                if keep.any():
                    t, x = t[keep], x[keep]
                    norm = math.sqrt(float((weights[t] * x.astype(float) ** 2).sum()))
                    for name, value in zip(out, (row, i, none, norm, t.tobytes(), x.astype("<i4").tobytes())):
                        out[name].append(value)
            yield pd.DataFrame(out)

    return run


class Bucket:
    """Neighbours in length: coordinates by document and by term."""

    def __init__(self, rows: pd.DataFrame, roots: np.ndarray):
        sizes = rows["t"].str.len().to_numpy() // 4
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.sizes, self.norm = sizes, rows["norm"].to_numpy(dtype=float)
        self.terms = np.frombuffer(b"".join(rows["t"]), "<i4")
        self.x = np.frombuffer(b"".join(rows["x"]), "<i4").astype(np.int64)
        order = self.terms.argsort(kind="stable")
        self.held, first = np.unique(self.terms[order], return_index=True)
        self.slices = dict(zip(self.held.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)])))
        self.by_term = np.repeat(np.arange(len(rows)), sizes)[order]
        self.p = self.x[order] * roots[self.terms[order]]
        self.ids, self.none = rows["id"].to_numpy(dtype=np.int64), rows["none"].to_numpy(dtype=bool)
        self.row = rows["row"].to_numpy(dtype=np.int64)

    def survivors(self, terms: np.ndarray, values: np.ndarray, rest: float, least: float) -> np.ndarray:
        """Documents whose bound reaches ``least``: their inner product on the
        focus coordinates, and the lengths of what remains."""
        met, square = np.zeros(len(self.norm)), self.norm**2
        for t, q in zip(terms.tolist(), values.tolist()):
            if t in self.slices:
                a, b = self.slices[t]
                met[self.by_term[a:b]] += q * self.p[a:b]
                square[self.by_term[a:b]] -= self.p[a:b] ** 2
        bound = met + rest * np.sqrt(np.maximum(square, 0) + 1e-9 * self.norm**2)
        return np.flatnonzero(bound * _SLACK >= least)

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of the documents at ``at``."""
        ends = np.cumsum(self.sizes[at])
        starts = ends - self.sizes[at]
        place = np.arange(ends[-1]) - np.repeat(starts - self.starts[at], self.sizes[at])
        return np.add.reduceat(query[self.terms[place]] * self.x[place], starts)


class Best:
    """The k best of one query so far; ``least`` is what a score has to reach."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)
        self.kept = np.zeros((0, 4), np.int64)  # score, id, null id, row

    def add(self, scores: np.ndarray, bucket: Bucket, at: np.ndarray) -> None:
        keep = scores >= self.least
        if not keep.any():
            return
        scores, at = scores[keep], at[keep]
        new = np.stack([scores, bucket.ids[at], bucket.none[at], bucket.row[at]], axis=1)
        both = np.concatenate([self.kept, new])
        self.kept = both[np.lexsort((both[:, 3], both[:, 1], both[:, 2], -both[:, 0]))[: self.k]]
        if len(self.kept) == self.k:
            self.least = max(self.least, int(self.kept[-1, 0]))


def _search(queries: Queries, weights: np.ndarray, k: int, bucket: int, focus: int, least: dict[int, int]):
    def run(batches):
        roots = np.sqrt(weights.astype(float))
        plans, best = [], []
        for item, terms, counts in queries.items:
            useful = weights[terms] > 0
            terms, counts = terms[useful], counts[useful]
            values = counts * roots[terms]
            order = np.argsort(-values, kind="stable")
            length, rest = math.sqrt((values**2).sum()), math.sqrt((values[order[focus:]] ** 2).sum())
            plans.append((terms, counts * weights[terms], terms[order[:focus]], values[order[:focus]], rest, length))
            best.append(Best(k, least.get(item, 1)))
        query = np.zeros(len(weights), np.int64)
        for rows in batches:
            for at in range(0, len(rows), bucket):
                part = Bucket(rows.iloc[at : at + bucket], roots)
                longest = part.norm.max() * _SLACK
                for (terms, exact, first, values, rest, length), own in zip(plans, best):
                    if not len(terms) or length * longest < own.least:
                        continue
                    live = part.survivors(first, values, rest, own.least)
                    if len(live):
                        query[terms] = exact
                        own.add(part.scores(live, query), part, live)
                        query[terms] = 0
        for (item, _, _), own in zip(queries.items, best):
            if len(own.kept):
                score, ids, none, row = own.kept.T
                yield pd.DataFrame({"item": item, "row": row, "id": ids, "none": none == 1, "score": score})

    return run


def build_vectors(docs: DataFrame, queries: Queries) -> tuple[DataFrame, np.ndarray]:
    """Staged impact vectors, ordered by length over range partitions, and the
    weights of the queries' terms."""
    terms = docs.sparkSession.sparkContext.broadcast(queries.terms)
    counted = docs.mapInPandas(lambda b: _count(terms.value)(b), "row long, id long, none boolean, n long, t binary, f binary")
    counted = stage(counted, "term-counts")
    size = counted.where("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens")).first()
    documents, tokens = size.documents, size.tokens or 1
    held = counted.select("t").mapInPandas(lambda b: _document_counts(terms.value)(b), "term long, df long")
    weights = np.zeros(len(queries.terms), np.int64)
    for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the block's terms
        weights[r.term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
    vectors = counted.where("length(t) > 0").mapInPandas(
        _vectors(weights, documents, tokens), "row long, id long, none boolean, norm double, t binary, x binary"
    )
    # rows of equal length, such as copies, are spread by their number
    vectors = vectors.repartitionByRange(F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
    return stage(vectors, "impact-vectors"), weights


def search(vectors: DataFrame, queries: Queries, weights: np.ndarray, k: int = K, bucket: int = BUCKET, focus: int = FOCUS) -> DataFrame:
    """``item, rank, doc_id, score`` for the queries of a block."""
    schema = "item long, row long, id long, none boolean, score long"

    def best_of(rows: DataFrame, least: dict[int, int]) -> DataFrame:
        found = rows.mapInPandas(_search(queries, weights, k, bucket, focus, least), schema)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "none", "id", "row")
        return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)

    n = vectors.count()
    least: dict[int, int] = {}
    if n > 2 * SEED_ROWS:
        longest = vectors.agg(F.percentile_approx("norm", 1 - SEED_ROWS / n, 10_000)).first()[0]
        seeds = best_of(vectors.where(F.col("norm") >= longest), {})
        least = {r.item: r.score for r in seeds.where(F.col("rank") == k).select("item", "score").collect()}
    return best_of(vectors, least).select("item", "rank", F.when(~F.col("none"), F.col("id")).alias("doc_id"), "score")


def rank(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", k: int = K, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k highest-scoring documents of
    each item."""
    own = F.col(id_col).cast("long")
    docs = documents.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("none"), F.col(text_col).alias("text"))
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(item_text_col), F.lit(""))), F.lit(TERM), F.lit(1))
    asked = items.select(F.col(item_col).alias("item_id"), words.alias("words")).where("size(words) > 0")
    asked = stage(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    total = asked.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    blocks = -(-total // block_terms)
    names = asked.select("item", "item_id")
    found = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "words").collect()
        queries = Queries.of((r.item, Counter(w.encode() for w in r.words)) for r in sorted(mine, key=lambda r: r.item))
        if queries.items:
            vectors, weights = build_vectors(docs, queries)
            part = stage(search(vectors, queries, weights, k), "ranked")
            found = part if found is None else found.union(part)
    if found is None:
        return names.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")
