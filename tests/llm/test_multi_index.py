import duckdb
import numpy as np
import pytest

from llm_data import SF_MID, bag
from tablewright.llm import multi_index, queries

NAMES = ["vec_id", "n_links", "component_id", "kept"]


def brute(rows, cosine=multi_index.COSINE):
    """Rows (vec_id, vector, label): links by comparing all pairs, components by walking them."""
    unit = {}
    for i, (_, v, label) in enumerate(rows):
        v = np.array([np.nan if x is None else x for x in v or []], dtype=float)
        if label is not None and v.size and np.isfinite(v).all() and v.any():
            unit[i] = v / np.linalg.norm(v)
    near = {i: [] for i in range(len(rows))}
    for i in unit:
        for j in unit:
            if i != j and rows[i][2] == rows[j][2] and unit[i].shape == unit[j].shape and unit[i] @ unit[j] >= cosine:
                near[i].append(j)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, len(near[i]), least, vec_id is not None and vec_id == least))
    return out


def planted(seed, n, dim=32, labels=3):
    """Random vectors, copies, scaled copies, chains and clusters of near copies."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base, label = rng.standard_normal(dim), int(rng.integers(labels))
        kind = rng.integers(6)
        rows.append((base, label))
        if kind == 0:
            rows += [(base, label)] * 3 + [(base * 4, label), (base, label + 1)]
        elif kind == 1:
            rows += [(base + rng.standard_normal(dim) * rng.uniform(0.05, 0.6), label) for _ in range(12)]
        elif kind == 2:
            for _ in range(6):  # a chain
                base = base + rng.standard_normal(dim) * 0.3
                rows.append((base, label))
    ids = rng.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in v], label) for i, (v, label) in zip(ids, rows)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, label, 7, 8) for i, v, label in rows], "vec_id long, embedding array<float>, label int, node int, w int")
    out = multi_index.near_duplicates(df.repartition(4), **kw)
    assert out.columns == NAMES
    return [tuple(r) for r in out.collect()]


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_MID}/embeddings.parquet'")
    want = db.execute(queries.ORACLE["op11_multi_index"])
    got = queries.op11_multi_index(spark, SF_MID)
    assert bag(got.columns, got.collect()) == bag([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("chunk", [multi_index.CHUNK, 16])
def test_recall_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(multi_index, "CHUNK", chunk)
    monkeypatch.setattr(multi_index, "CELL_ROWS", 16)
    rows = planted(3, 700)
    want, got = {r[0]: r for r in brute(rows)}, {r[0]: r for r in run(spark, rows)}
    assert sorted(got) == sorted(want)
    n, missed = sum(r[1] for r in want.values()), sum(abs(want[i][1] - got[i][1]) for i in want)
    assert n > 1500 and missed <= 0.02 * n
    assert all(got[i][1] <= want[i][1] for i in want)  # no link below the cosine
    assert sum(got[i][2] == want[i][2] for i in want) >= 0.97 * len(want)


def test_every_link_when_all_cells_are_visited(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "CHUNK", 8)
    monkeypatch.setattr(multi_index.Grid, "_calibrated", lambda *a: 1e9)
    rows = planted(4, 400)
    assert sorted(run(spark, rows)) == sorted(brute(rows))


def test_recall_of_links_at_the_least_cosine():
    """Of pairs at just over the least cosine in random directions, and other
    vectors than those the slack was calibrated on."""
    rng = np.random.default_rng(11)
    sample = multi_index.unit(rng.standard_normal((3000, 64)))
    grid = multi_index.Grid(sample, np.zeros(3000, str), 16, 0.93, multi_index.RECALL)
    a = multi_index.unit(rng.standard_normal((2000, 64)))
    away = rng.standard_normal(a.shape)
    away = multi_index.unit(away - (away * a).sum(1, keepdims=True) * a)
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * away
    va, vb = grid.visits(a), grid.visits(b)
    found = np.mean([vb[i][0] in va[i] if va[i][0] >= vb[i][0] else va[i][0] in vb[i] for i in range(len(a))])
    assert found >= 0.97
    assert np.mean([len(v) for v in va]) < 0.3 * 256  # and far from all cells


def test_traversal_is_by_growing_distance():
    rng = np.random.default_rng(2)
    grid = multi_index.Grid(multi_index.unit(rng.standard_normal((500, 16))), np.zeros(500, str), 8, 0.9, 0.99)
    first, second = rng.random(8), rng.random(8)
    grid.slack = 0.7
    order = list(grid.traverse(first, second))
    cost = (first[:, None] + second[None, :]).ravel()
    assert order == [c for c in np.argsort(cost, kind="stable") if cost[c] <= cost.min() + 0.7]


def test_odd_rows(spark):
    one, nan = [1.0, 2.0, 0.5], float("nan")
    rows = [
        (1, one, 0), (1, one, 0), (2, [2.0, 4.0, 1.0], 0), (3, one, None), (4, one, 1), (5, None, 0), (6, [], 0), (7, [0.0] * 3, 0),
        (8, [1.0, None, 0.5], 0), (9, [nan, 1.0, 1.0], 0), (10, [float("inf"), 1.0, 0.0], 0), (11, [1.0, 2.0], 0), (12, [5.0], 0),
        (13, [3.0], 0), (14, [-3.0], 0), (None, one, 0), (None, [9.0, 0.0, 0.0], 0), (-5, [1e-30, 2e-30, 5e-31], 0), (15, [1e30, 2e30, 5e29], 0),
    ]
    want = brute([(i, [x * 1e20 for x in v] if i == -5 else v, label) for i, v, label in rows])
    assert sorted(map(str, run(spark, rows))) == sorted(map(str, want))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert multi_index.near_duplicates(empty).collect() == []
    assert run(spark, [(1, one, 0)]) == [(1, 0, 1, True)]
    assert run(spark, [(1, None, 0)]) == [(1, 0, 1, True)]
    many = [(i, one, 0) for i in range(3000)] + [(5000, [-1.0, 0.0, 0.0], 0)]
    assert sorted(run(spark, many)) == [(i, 2999, 0, i == 0) for i in range(3000)] + [(5000, 0, 5000, True)]
