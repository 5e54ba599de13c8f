import math
import random
import re
from collections import Counter

import duckdb
import pytest

from llm_data import SF_MID, bag
from tablewright.llm import norm_buckets, queries

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=norm_buckets.K):
    """Every item's k best by scoring all documents."""
    bags = [Counter(re.findall(PATTERN, (t or "").translate(ASCII))) for _, t in docs]
    n_docs, n_terms = sum(1 for b in bags if b), sum(sum(b.values()) for b in bags)
    df, out = Counter(t for b in bags for t in b), []
    for item_id, text in items:
        asked, found = Counter(re.findall(PATTERN, (text or "").translate(ASCII))), []
        for (doc_id, _), have in zip(docs, bags):
            n, score = sum(have.values()), 0
            for t in asked.keys() & have.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += asked[t] * w * ((10**9 * have[t]) // (1000 * have[t] + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, row int, norm string").repartition(5)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, item string")
    got = norm_buckets.rank(d, b, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query_matches_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_MID}/{t}.parquet'")
    want = db.execute(queries.ORACLE["op12_norm_buckets"])
    names, rows = [d[0] for d in want.description], want.fetchall()
    got = queries.op12_norm_buckets(spark, SF_MID)
    assert bag(got.columns, got.collect()) == bag(names, rows) and len(rows) > 500


@pytest.mark.parametrize("bucket, focus, block, seeds", [(4, 1, 10**6, 8), (64, 3, 40, 8), (2048, 6, 10**6, 8192)])
def test_small_buckets_match_all_pairs(spark, monkeypatch, bucket, focus, block, seeds):
    monkeypatch.setattr(norm_buckets, "SEED_ROWS", seeds)
    monkeypatch.setattr(norm_buckets.search, "__defaults__", (norm_buckets.K, bucket, focus))
    rng = random.Random(bucket)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 10, 40, 200])))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)]  # copies, told apart by their ids
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(15)] + [(50, docs[7][1]), (51, docs[8][1])]
    assert run(spark, docs, items, block_terms=block) == plain(docs, items)


def test_pruning_drops_buckets_and_documents():
    """On skewed lengths most buckets are never opened, and none that is
    opened is scored whole."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    n = 4096
    t = [np.sort(rng.choice(50, 6, replace=False)).astype("<i4") for _ in range(n)]
    x = [rng.integers(1, 1 + int(1e6 / (1 + i)), 6).astype("<i4") for i in range(n)]
    norm = [float(np.sqrt((v.astype(float) ** 2).sum())) for v in x]
    rows = pd.DataFrame({"row": range(n), "id": range(n), "none": False, "norm": norm, "t": [v.tobytes() for v in t], "x": [v.tobytes() for v in x]})
    rows = rows.sort_values("norm", ascending=False)
    asked = norm_buckets.Queries({}, [(0, np.arange(20), np.ones(20, np.int64))])
    opened, scored = [], []

    class Seen(norm_buckets.Bucket):
        def survivors(self, *a):
            opened.append(1)
            got = super().survivors(*a)
            scored.append(len(got))
            return got

    own = norm_buckets.Bucket
    norm_buckets.Bucket = Seen
    try:
        (got,) = norm_buckets._search(asked, np.ones(50, np.int64), 5, 128, 6, {})(iter([rows]))
    finally:
        norm_buckets.Bucket = own
    want = sorted(((int(v[u < 20].sum()), -i) for i, (u, v) in enumerate(zip(t, x))), reverse=True)[:5]
    assert [(s, -i) for s, i in zip(got["score"], got["id"])] == want
    assert len(opened) <= 8 and scored[0] == 128 and all(s < 40 for s in scored[1:])


def test_odd_rows(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "alpha Beta, lorem"), (1, "alpha Beta, lorem"), (None, "gamma"), (2, None), (3, ""), (4, "--"), (5, "absent"), (6, "İSTANBUL été 한국어 É")]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []
    far = [(2**60 + i, "alpha beta") for i in range(3)] + [(None, "alpha beta"), (-4, "alpha beta"), (0, "alpha")] + [(9, f"other w{i}") for i in range(9)]
    assert run(spark, far, [(2**61, "alpha beta alpha")]) == plain(far, [(2**61, "alpha beta alpha")])
    text = "alpha " * 1_500_000 + "Omega"  # longer than is split at once
    assert norm_buckets.count_terms(text) == {b"alpha": 1_500_000, b"omega": 1}
