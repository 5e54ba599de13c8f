"""Exact top-k by inner product: a Voronoi join of queries and data.

Vectors are quantised to integers and dealt to the nearest of ``pivots``
(a bounded sample; any choice gives the same result).  Summaries of the cells
(rings of a pivot: count, radius) bound a query's score with any member x of a
cell of pivot p and radius r: <q,p> - |q|r <= <q,x> <= <q,p> + |q|r.  The lower
bounds give each query a score that k candidates surely reach; the query is
sent only to groups with a cell whose upper bound reaches it.  There the local
top k is found with exact integer arithmetic, and the local lists are merged.

Groups are dealt in chunks of ``CHUNK`` vectors, queries in slices of
``SLICE``, cell by cell, so a vector that a third of the rows share is no hot
group; a chunk is sent to the slices that have a query for it, and to no other.  Only
the pivots and the cell summaries (at most pivots x rings rows for each
dimension) reach the driver.

Defined cases: vectors that are null or hold null or non-finite components,
and rows with a null id, take no part; vectors of different dimension are
never compared; repeated rows are candidates, and queries, of their own; other
columns are ignored; an empty table gives no rows; scores beyond a long are
clipped.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import small, stage

K = 5
PIVOTS_MOST = 256
CHUNK = 8192
SLICE = 65_536

_LIMIT = 2**63 - 1


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def _finite(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & ok


def _matrix(vectors, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype="<i8").reshape(len(vectors), dim)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: as doubles where they stay below 2^53."""
    peak = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if peak < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, -_LIMIT, _LIMIT).astype(np.int64) if exact.size else np.zeros(exact.shape, np.int64)


def _top(scores: np.ndarray, k: int):
    """Rounds of (row, column) of the best remaining score; columns are in id
    order, so the first of equal scores wins."""
    scores, rows = scores.copy(), np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        best = scores.argmax(1)
        live = scores[rows, best] > -_LIMIT - 1
        yield rows[live], best[live]
        scores[rows, best] = -_LIMIT - 1


class Pivots:
    """Pivot matrices by dimension; a dimension without one has the origin."""

    def __init__(self, vectors: list[list[int]]):
        by_dim: dict[int, set[tuple[int, ...]]] = {}
        for v in vectors:
            by_dim.setdefault(len(v), set()).add(tuple(v))
        self.by_dim = {d: np.array(sorted(vs), dtype=float) for d, vs in by_dim.items()}

    def of(self, dim: int) -> np.ndarray:
        return self.by_dim.get(dim, np.zeros((1, dim)))


def _assign(pivots: Pivots):
    def run(batches):
        for rows in batches:
            dims = rows["v"].str.len().to_numpy()
            out = rows.assign(dim=dims, g=0, r=0.0)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x, p = np.array([np.asarray(v, dtype="<i8") for v in rows["v"].to_numpy()[at]]).reshape(len(at), dim), pivots.of(dim)
                g, r = np.zeros(len(at), np.int64), np.zeros(len(at))
                for a in range(0, len(at), 1024):
                    part = x[a : a + 1024].astype(float)
                    g[a : a + 1024] = ((p**2).sum(1) - 2 * part @ p.T).argmin(1)
                    r[a : a + 1024] = np.sqrt(((part - p[g[a : a + 1024]]) ** 2).sum(1))
                out.iloc[at, out.columns.get_loc("g")] = g
                out.iloc[at, out.columns.get_loc("r")] = r * (1 + 1e-9)
            out["v"] = [np.asarray(v, dtype="<i8").tobytes() for v in rows["v"]]
            yield out[["row", "vec_id", "dim", "g", "r", "v"]]

    return run


def _route(pivots: Pivots, cells: dict[int, np.ndarray], k: int):
    """Groups that each query has to visit.  ``cells``: by dimension, rows of
    (group, count, radius)."""

    def run(batches):
        for rows in batches:
            for dim, part in rows.groupby("dim"):
                cell, p = cells[dim], pivots.of(dim)
                q = _matrix(part["v"], dim).astype(float)
                centre = (q @ p.T)[:, cell[:, 0].astype(int)]
                reach = np.sqrt((q**2).sum(1))[:, None] * cell[None, :, 2]
                slack = 1e-6 * (1 + np.abs(centre) + reach)
                low, high = centre - reach - slack, centre + reach + slack
                order = np.argsort(-low, axis=1)
                # k + 1: the query itself may be among the candidates
                enough = np.cumsum(cell[:, 1][order], axis=1) >= k + 1
                first = enough.argmax(1)
                sure = np.where(enough.any(1), np.take_along_axis(low, order, 1)[np.arange(len(q)), first], -np.inf)
                visits = high >= sure[:, None]
                groups = [np.unique(cell[v, 0]).astype(int).tolist() for v in visits]
                yield pd.DataFrame({"row": part["row"], "vec_id": part["vec_id"], "dim": dim, "own": part["g"], "v": part["v"], "groups": groups})

    return run


def _sliced(routed: DataFrame) -> DataFrame:
    """Queries with a slice of about ``SLICE``: along the cells that they are
    in themselves, so that a slice's queries ask for few groups."""
    cells = routed.groupBy("dim", "own").agg(F.count("*").alias("n")).orderBy("dim", "own").collect()  # at most the pivots of each dimension
    starts, at = [], 0
    for c in cells:
        starts.append((c.dim, c.own, at, c.n))
        at += c.n
    place = routed.sparkSession.createDataFrame(starts, "dim int, own long, at long, n long")
    routed = routed.join(F.broadcast(place), ["dim", "own"])
    slice_ = F.floor((F.col("at") + F.pmod(F.xxhash64("row"), F.col("n"))) / F.lit(SLICE)).cast("int")
    return routed.withColumn("slice", slice_).drop("own", "at", "n")


def top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K
) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``is_query`` is a condition on a
    column ``vec_id``."""
    v = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & _finite(v)).select(F.col(id_col).alias("vec_id"), quantised(v).alias("v"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    wanted = int(min(PIVOTS_MOST, max(1, n**0.5 / 2)))
    pivots = Pivots([r.v for r in rows.orderBy(F.xxhash64("row"), "row").limit(wanted).collect()])
    data = rows.mapInPandas(_assign(pivots), "row long, vec_id long, dim int, g long, r double, v binary")
    data = stage(data, "assigned")
    ring = F.floor(2 * F.log2(F.col("r") + 1))
    cells: dict[int, list] = {}
    for c in data.groupBy("dim", "g", ring.alias("ring")).agg(F.count("*").alias("n"), F.max("r").alias("r")).collect():
        cells.setdefault(c.dim, []).append((c.g, c.n, c.r))
    by_dim = {d: np.array(sorted(x), dtype=float) for d, x in cells.items()}
    sizes: dict[tuple[int, int], int] = {}
    for d, x in cells.items():
        for g, count, _ in x:
            sizes[d, g] = sizes.get((d, g), 0) + count
    chunks = data.sparkSession.createDataFrame(
        [(d, g, -(-count // CHUNK)) for (d, g), count in sizes.items()], "dim int, g long, chunks int"
    )
    queries = data.where(is_query)
    routed = queries.mapInPandas(_route(pivots, by_dim, k), "row long, vec_id long, dim int, own long, v binary, groups array<long>")
    routed = _sliced(stage(routed, "routed"))
    routed = routed.withColumn("g", F.explode("groups")).drop("groups").join(F.broadcast(chunks), ["dim", "g"])
    routed = routed.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    held = data.join(F.broadcast(chunks), ["dim", "g"])  # one row for each group, as collected above
    held = held.withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    held = held.join(small(stage(routed.select("dim", "g", "chunk", "slice").distinct(), "wanted")), ["dim", "g", "chunk"])

    def solve(key: tuple, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(x) and len(q):
            dim = int(key[0])
            x = x.sort_values(["vec_id", "row"])
            xs, ids, own = _matrix(x["v"], dim), x["vec_id"].to_numpy(), x["row"].to_numpy()
            for at in range(0, len(q), 512):
                part = q.iloc[at : at + 512]
                scores = products(_matrix(part["v"], dim), xs)
                scores[part["row"].to_numpy()[:, None] == own[None, :]] = -_LIMIT - 1
                for r, c in _top(scores, k):
                    out.append(pd.DataFrame({
                        "row": part["row"].to_numpy()[r], "query_id": part["vec_id"].to_numpy()[r], "vec_id": ids[c], "score": scores[r, c],
                    }))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "query_id", "vec_id", "score")})

    keys = ["dim", "g", "chunk", "slice"]
    local = held.select(*keys, "row", "vec_id", "v").groupBy(*keys).cogroup(
        routed.select(*keys, "row", "vec_id", "v").groupBy(*keys)
    ).applyInPandas(solve, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = local.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
