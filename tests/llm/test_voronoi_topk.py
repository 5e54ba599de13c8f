import duckdb
import random

from pyspark.sql import functions as F

from llm_data import SF_MID, bag
from tablewright.llm import queries, voronoi_topk


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_MID}/embeddings.parquet')")
    res = con.execute(queries.ORACLE["op4_topk"])
    df = queries.op4_topk(spark, SF_MID)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag([c[0] for c in res.description], res.fetchall())


def slow(rows, is_query, k):
    ints = [(i, [int(x * 256 // 1) for x in v]) for i, v in rows]
    out = []
    for a, (i, q) in enumerate(ints):
        if is_query(i):
            scored = [(-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(ints) if b != a and len(v) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_ties_repeats_dimensions_and_chunks(spark, monkeypatch):
    rng = random.Random(2)
    same = [0.5, -0.25, 0.125]
    good = [(i, same) for i in range(30)] + [(i, [rng.uniform(-2, 2) for _ in range(3)]) for i in range(30, 90)]
    good += [(90, [1.0]), (92, [2.0]), (94, []), (100, [3e6, 2.0, 1.0]), (10, same), (96, [0.0, 0.0, 0.0])]
    bad = [(200, None), (202, [1.0, None, 2.0]), (204, [float("nan"), 1.0, 1.0]), (206, [1.0, float("-inf"), 1.0]), (None, same)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id long, embedding array<double>, g int, row string")
    monkeypatch.setattr(voronoi_topk, "CHUNK", 7)
    monkeypatch.setattr(voronoi_topk, "SLICE", 5)
    for k in (1, 5, 200):
        got = sorted(tuple(r) for r in voronoi_topk.top_k(df, F.col("vec_id") % 2 == 0, k=k).collect())
        assert got == slow(good, lambda i: i % 2 == 0, k)
    assert voronoi_topk.top_k(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_far_groups_are_not_visited():
    import numpy as np
    import pandas as pd

    pivots = voronoi_topk.Pivots([[100, 0], [-100, 0]])
    cells = {2: np.array([[0, 10, 5.0], [1, 10, 5.0]])}
    q = pd.DataFrame({"row": [1], "vec_id": [1], "dim": [2], "g": [0], "v": [np.array([-90, 3], "<i8").tobytes()]})
    assert next(voronoi_topk._route(pivots, cells, 5)([q]))["groups"].tolist() == [[0]]


def test_a_chunk_goes_to_the_slices_that_ask_for_it(spark, monkeypatch):
    """Copies of the data sent follow the queries' groups, not the number of slices."""
    rng = random.Random(8)
    good = [(i, [(-1) ** (i // 150) * 20 + rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(300)]  # two far clusters
    df = spark.createDataFrame(good, "vec_id long, embedding array<double>")
    monkeypatch.setattr(voronoi_topk, "SLICE", 10)
    monkeypatch.setattr(voronoi_topk, "CHUNK", 50)
    sent = []
    real = voronoi_topk.small

    def seen(wanted):
        sent.append([tuple(r) for r in wanted.select("dim", "g", "chunk", "slice").collect()])
        return real(wanted)

    monkeypatch.setattr(voronoi_topk, "small", seen)
    got = sorted(tuple(r) for r in voronoi_topk.top_k(df, F.col("vec_id") % 2 == 0).collect())
    assert got == slow(good, lambda i: i % 2 == 0, 5)
    (wanted,) = sent
    slices = 1 + max(s for *_, s in wanted)
    chunks = {c for *c, _ in map(tuple, wanted) for c in [tuple(c)]}
    assert slices >= 15 and len(wanted) == len(set(wanted)) < 0.7 * slices * len(chunks)


def test_columns_named_like_its_own(spark):
    rows = [(i, [float(i), 1.0], 5, 6, 7, 8) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int, g int, dim int, slice int")
    got = sorted(tuple(r) for r in voronoi_topk.top_k(df, F.col("vec_id") % 9 == 0).collect())
    assert got == slow([(i, v) for i, v, *_ in rows], lambda i: i % 9 == 0, 5)
