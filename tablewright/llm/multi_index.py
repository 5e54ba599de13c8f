"""Near-duplicate vectors through an inverted multi-index.

Vectors are scaled to length one and cut in halves; each half has a codebook
of its own, fitted on a bounded sample (``SAMPLE_ROWS``), and the product of
the two codebooks is a grid of cells.  Every vector is filed under its label
and the cell of its two nearest codewords.  To find its partners a vector
traverses the grid by the multi-sequence algorithm: the codewords of both
halves are ordered by distance, and cells come out by growing sum of the two
squared distances.  The traversal stops where the sum exceeds that of the own
cell by ``slack``; the slack is calibrated on the sample so that ``RECALL`` of
the partners at exactly the least cosine, and of the sample's true links, lie
in cells visited.  Candidates are verified by their cosine in doubles.

A vector visits only cells that do not come after its own, so every pair meets
once.  Equal vectors of a label are one class with a weight; the classes of a
cell are dealt into chunks of ``CHUNK`` and visitors meet each chunk, so a cell
that a third of all rows fall into is many groups.  A group returns the number
of links of each class and a spanning forest of its links, never the pairs.
Only the sample, the codebooks and counts reach the driver.

Defined cases: a row whose label is null, or whose vector is null, zero, empty
or holds null or non-finite components, links with nothing and is its own
component; vectors of different dimension never link; repeated rows are
vectors of their own; a null id stays null, and a component takes its least
id (null if it has none); other columns are ignored; an empty table gives no
rows.
"""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import small, stage
from tablewright.llm.components import components

COSINE = 0.93
RECALL = 0.995
SAMPLE_ROWS = 20_000
CELL_ROWS = 512
CODES_MOST = 128
CHUNK = 4096

_BLOCK = 512
_TRIES = 2_000  # vectors of the sample that the slack is calibrated on


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their greatest component, so that
    neither very small nor very large ones leave the doubles."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


def _fit(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from farthest-first seeds, the same for the same points."""
    seeds, gap = [0], ((points - points[0]) ** 2).sum(1)
    while len(seeds) < k and gap.max() > 0:
        seeds.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[seeds[-1]]) ** 2).sum(1))
    codes = points[seeds].copy()
    for _ in range(rounds):
        near = _distances(points, codes).argmin(1)
        for c in range(len(codes)):
            if (near == c).any():
                codes[c] = points[near == c].mean(0)
    return codes


def _distances(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ codes.T + (codes**2).sum(1), 0)


class Grid:
    """Codebooks of the two halves and the slack of the traversal, for vectors
    of one dimension."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, codes: int, cosine: float, recall: float):
        self.half = sample.shape[1] // 2
        self.books = [_fit(x, codes) if x.shape[1] else np.zeros((1, 0)) for x in (sample[:, : self.half], sample[:, self.half :])]
        self.slack = self._calibrated(sample, labels, cosine, recall)

    def distances(self, points: np.ndarray) -> list[np.ndarray]:
        return [_distances(x, b) for x, b in zip((points[:, : self.half], points[:, self.half :]), self.books)]

    def cells(self, points: np.ndarray) -> np.ndarray:
        a, b = (d.argmin(1) for d in self.distances(points))
        return a * len(self.books[1]) + b

    def _calibrated(self, sample: np.ndarray, labels: np.ndarray, cosine: float, recall: float) -> float:
        """The sum's excess over the own cell's that ``recall`` of the links
        need: of partners in random directions at the least cosine, and of
        true links of the sample, whichever need more."""
        rng = np.random.default_rng(1)
        tries = sample[:_TRIES]
        away = rng.standard_normal(tries.shape)
        away -= (away * tries).sum(1, keepdims=True) * tries
        length = np.sqrt((away**2).sum(1, keepdims=True))
        away = np.divide(away, length, out=np.zeros_like(away), where=length > 1e-9)
        pairs = [(tries, cosine * tries + np.sqrt(max(0.0, 1 - cosine**2)) * away)]
        one, other = np.nonzero((tries @ tries.T >= cosine) & (labels[: len(tries), None] == labels[None, : len(tries)]))
        if len(one):
            pairs.append((tries[one], tries[other]))
        return max(float(np.quantile(self._excess(a, b), recall)) for a, b in pairs) + 1e-9

    def _excess(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What reaching the partner's cell costs over the own one, for the
        vector of the two whose cell comes after."""
        home, there = self.cells(a), self.cells(b)
        later = (home >= there)[:, None]
        first, second = self.distances(np.where(later, a, b))
        goal = np.where(home >= there, there, home)
        n, rows = len(self.books[1]), np.arange(len(goal))
        return first[rows, goal // n] + second[rows, goal % n] - first.min(1) - second.min(1)

    def traverse(self, first: np.ndarray, second: np.ndarray):
        """Multi-sequence traversal for one vector's distances to the two
        codebooks: cells by growing sum, until the slack is used up."""
        by_first, by_second = first.argsort(kind="stable"), second.argsort(kind="stable")
        limit = first[by_first[0]] + second[by_second[0]] + self.slack
        heap = [(first[by_first[0]] + second[by_second[0]], 0, 0)]
        while heap:
            cost, i, j = heapq.heappop(heap)
            if cost > limit:
                return
            yield int(by_first[i]) * len(second) + int(by_second[j])
            if j + 1 < len(second):
                heapq.heappush(heap, (first[by_first[i]] + second[by_second[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (first[by_first[i + 1]] + second[by_second[0]], i + 1, 0))

    def visits(self, points: np.ndarray) -> list[list[int]]:
        """For each point its own cell, then the visited cells before it."""
        first, second = self.distances(points)
        home = self.cells(points)
        return [[int(h), *(c for c in self.traverse(a, b) if c < h)] for h, a, b in zip(home, first, second)]


def fit_grids(classes: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> dict[int, Grid]:
    """A grid for each dimension, from ``SAMPLE_ROWS`` classes, more or less,
    chosen by hash.  The codebooks are sized for ``CELL_ROWS`` classes of the largest
    label to a cell, with at most ``CODES_MOST`` codewords a half.  A dimension
    not in the sample has one cell."""
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    codes = int(min(CODES_MOST, max(4, np.ceil((most / CELL_ROWS) ** 0.5))))
    share = min(1.0, SAMPLE_ROWS / max(1, classes.count()))
    chosen = classes.where(F.pmod(F.xxhash64("v", "label"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1))
    by_dim: dict[int, list] = {}
    for r in sorted(chosen.select("label", "v").limit(2 * SAMPLE_ROWS).collect(), key=lambda r: (r.v, str(r.label))):
        by_dim.setdefault(len(r.v), []).append((r.label, r.v))
    return {
        d: Grid(unit(np.array([v for _, v in rows], dtype=float)), np.array([str(x) for x, _ in rows]), codes, cosine, recall)
        for d, rows in by_dim.items()
    }


def file_vectors(classes: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """``node, label, dim, w, v`` (scaled, as bytes) and ``visits``: the own
    cell, then the others to look into."""

    def run(batches):
        for rows in batches:
            dims = rows["v"].str.len().to_numpy()
            for dim in np.unique(dims):
                part = rows[dims == dim]
                points = unit(np.array(part["v"].tolist(), dtype=float))
                grid = grids.get(int(dim))
                yield pd.DataFrame({
                    "node": part["node"], "label": part["label"], "dim": dim, "w": part["w"], "v": [p.tobytes() for p in points],
                    "visits": grid.visits(points) if grid else [[0]] * len(points),
                })

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("node", "label", "w", "v").mapInPandas(run, f"node long, label {label}, dim int, w long, v binary, visits array<int>")


def _matrix(part: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(part["v"]), dtype="<f8").reshape(len(part), -1)


def _merge(label: np.ndarray, one: np.ndarray, other: np.ndarray) -> None:
    """Join the classes of linked positions in ``label`` (least position)."""
    while len(one):
        a, b = label[one], label[other]
        open_ = a != b
        if not open_.any():
            return
        one, other, a, b = one[open_], other[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label[:] = label[label]


def verify(visitors: pd.DataFrame, held: pd.DataFrame, cosine: float) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Links between the visitors and the held classes of one cell: partners
    found (by weight) for each node, and a spanning forest.  Held classes that
    visit their own cell meet each later one once."""
    x, nodes = _matrix(held), held["node"].to_numpy()
    every = np.concatenate([visitors["node"].to_numpy(), nodes])
    found = np.zeros(len(every), np.int64)
    names, place = np.unique(every, return_inverse=True)
    label = np.arange(len(names))
    weight, own = held["w"].to_numpy(), visitors["home"].to_numpy()
    for at in range(0, len(visitors), _BLOCK):
        part = visitors.iloc[at : at + _BLOCK]
        near = _matrix(part) @ x.T >= cosine
        near &= ~own[at : at + _BLOCK, None] | (part["node"].to_numpy()[:, None] < nodes[None, :])
        one, other = np.nonzero(near)
        np.add.at(found, at + one, weight[other])
        np.add.at(found, len(visitors) + other, part["w"].to_numpy()[one])
        _merge(label, place[at + one], place[len(visitors) + other])
    links = pd.DataFrame({"node": every, "n": found})
    forest = pd.DataFrame({"a": names, "b": names[label]})
    return links[links["n"] > 0].groupby("node", as_index=False).sum(), forest[forest["a"] != forest["b"]]


def near_links(filed: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``a, b, n``: a forest link between nodes a and b (n null), or n links
    of node a (b null)."""
    cell = ["label", "dim", "cell"]
    held = filed.select("node", "label", "dim", "w", "v", F.col("visits")[0].alias("cell"))
    sizes = held.groupBy(*cell).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sizes = stage(sizes, "grid-cells")
    guests = filed.select("node", "label", "dim", "w", "v", F.posexplode("visits").alias("nth", "cell"))
    guests = guests.select("node", *cell, "w", "v", (F.col("nth") == 0).alias("home"))
    chunk_of = lambda df: df.join(small(sizes), cell)  # noqa: E731  cells without vectors are dropped here
    held = chunk_of(held).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    guests = chunk_of(guests).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    # visitors of a chunk come in parts, so that a group has a bounded share of them
    part_of = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    crowd = guests.groupBy(*cell, "chunk").agg(F.ceil(F.count("*") / (2 * CHUNK)).cast("int").alias("parts"))
    crowd = stage(crowd, "grid-visitors")
    guests = guests.join(small(crowd), [*cell, "chunk"]).withColumn("part", part_of)
    held = held.join(small(crowd), [*cell, "chunk"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    cols = [*cell, "chunk", "part", "node", "w", "v", "home", "guest"]
    rows = guests.withColumn("guest", F.lit(True)).select(cols).union(
        held.withColumn("home", F.lit(True)).withColumn("guest", F.lit(False)).select(cols)
    )
    group = [*cell, "chunk", "part"]
    shuffle = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = crowd.agg(F.sum(F.col("parts").cast("long"))).first()[0] or 0
    groups = max(shuffle, total // 8)
    rows = rows.withColumn("g", F.pmod(F.xxhash64(*group), F.lit(groups)))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in rows.groupby(group, dropna=False, sort=False):
            links, forest = verify(block[block["guest"]], block[~block["guest"]], cosine)
            out += [links.rename(columns={"node": "a"}), forest]
        got = pd.concat(out) if out else pd.DataFrame()
        return got.reindex(columns=["a", "b", "n"]).astype("Int64")

    return rows.groupBy("g").applyInPandas(compare, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, recall: float = RECALL,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.when(_usable(v), v.cast("array<double>")).alias("v"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "multi-index-rows")
    linked = F.col("label").isNotNull() & F.col("v").isNotNull()
    # equal vectors of a label are one class, named by its least row
    classes = rows.where(linked).groupBy("label", "v").agg(
        F.min("row").alias("node"), F.count("*").alias("w"), F.min("vec_id").alias("least")
    )
    classes = stage(classes, "multi-index-classes")
    filed = stage(file_vectors(classes, fit_grids(classes, cosine, recall)), "multi-index-filed")
    found = stage(near_links(filed, cosine), "multi-index-links")
    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"), "multi-index-components")
    member = classes.join(counts, "node", "left").join(roots, "node", "left")
    member = member.withColumn("root", F.coalesce("root", "node"))
    member = stage(member.select("label", "v", "root", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")), "multi-index-members")
    least = stage(member.groupBy("root").agg(F.min("least").alias("component_id")), "multi-index-least")
    member = member.join(small(least), "root").select("label", "v", "n_links", "component_id")
    joined = rows.where(linked).join(member, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~linked).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
