"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad.  A line's score uses its own features and
those of the lines before and after it; the chain's transition weights tie
neighbours together.  Forward-backward gives each line's marginal probability
of being good, and the document's quality is their mean, weighted by line
length.

Fitting uses a bounded sample of labelled documents (``FIT_DOCS``, those with
the least hash of their id, of at most ``FIT_LINES`` lines); every line of a
labelled document takes the document's label.  Scoring is one pass over all
whole texts without a shuffle.

Defined cases: a null or empty text is one empty line; repeated rows are
scored each; labels for unknown ids and null labels are ignored, of several
labels of one id the least counts; without labelled rows of both kinds every
line weighs nothing and scores are 0.5; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_DOCS = 3000
FIT_LINES = 400
STEPS = 120
CHAINS_AT_ONCE = 256
PENALTY = 1e-3
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "upper", "digits", "marks", "bangs", "bars", "blank", "distinct", "repeated", "word_chars", "twice", "ends",
)

# character classes: 1 upper, 2 digit, 3 mark, 4 white space, others letters
_LOW = np.array(
    [1 if chr(c).isupper() else 2 if chr(c).isdigit() else 4 if chr(c).isspace() else 0 if chr(c).isalpha() else 3 for c in range(0x600)],
    dtype=np.uint8,
)


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line lengths in code points)."""
    lines = (text or "").split("\n")
    n = np.array([len(x) for x in lines], dtype=np.int64)
    points = np.frombuffer("\n".join(lines).encode("utf-32-le"), dtype="<u4")
    kind = np.where(points < len(_LOW), _LOW[np.minimum(points, len(_LOW) - 1)], 0)
    edges = np.concatenate(([0], np.cumsum(n + 1)))

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[edges[1:] - 1] - total[edges[:-1]]) / np.maximum(n, 1)

    out = np.zeros((len(lines), len(FEATURES)))
    out[:, 0] = np.log1p(n) / 5
    out[:, 1], out[:, 2], out[:, 3] = share(kind == 1), share(kind == 2), share(kind == 3)
    out[:, 4], out[:, 5], out[:, 6] = share(points == 33), share(points == 124), share(kind == 4)
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    for i, x in enumerate(lines):
        words = x.split()
        k = len(words)
        if k:
            out[i, 7] = len(set(words)) / k
            out[i, 8] = sum(map(str.__eq__, words, words[1:])) / k
            out[i, 9] = min(20, (n[i] - k + 1) / k) / 10
            out[i, 10] = seen[x] > 1
            out[i, 11] = words[-1][-1] in ".!?"
    return out, n


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """A line's features beside those of the lines before and after it, and
    whether it is the first or last."""
    edge = np.zeros((1, x.shape[1]))
    first, last = np.zeros((len(x), 1)), np.zeros((len(x), 1))
    first[0], last[-1] = 1, 1
    return np.hstack([x, np.vstack([edge, x[:-1]]), np.vstack([x[1:], edge]), first, last])



@dataclass
class LineModel:
    """``weights`` of good against bad, ``bias``, 2 x 2 ``transitions``
    (from, to; 0 bad, 1 good); features are standardised first."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    transitions: np.ndarray

    def line_scores(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,j->i", (with_neighbours(x) - self.mean) / self.scale, self.weights) + self.bias

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Probability of good for every line of one document."""
        return chain_marginals([self.line_scores(x)], self.transitions)[0][0]

    def qualities(self, texts) -> np.ndarray:
        """Document qualities; chains of like length run together."""
        scores, lengths = [], []
        for text in texts:
            x, n = line_features(text)
            scores.append(self.line_scores(x))
            lengths.append(n if n.any() else np.ones(len(n)))
        out = np.zeros(len(scores))
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        for at in range(0, len(order), CHAINS_AT_ONCE):
            part = order[at : at + CHAINS_AT_ONCE]
            for i, p in zip(part, chain_marginals([scores[i] for i in part], self.transitions)[0]):
                out[i] = p @ lengths[i] / lengths[i].sum()
        return np.clip(out, 0.0, 1.0)

    def quality(self, text: str | None) -> float:
        return float(self.qualities([text])[0])


def chain_marginals(scores: list[np.ndarray], t: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Forward-backward over chains of log-odds ``scores`` at once.  Returns
    the marginals of good, expected transition counts, and the sum of the log
    partition functions."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    longest = int(sizes[0])
    e = np.zeros((len(order), longest))
    for r, i in enumerate(order):
        e[r, : sizes[r]] = scores[i]
    live = [int(np.searchsorted(-sizes, -s, side="left")) for s in range(longest)]  # chains longer than s
    fwd, bwd = np.zeros((longest, len(order), 2)), np.zeros((longest, len(order), 2))
    fwd[0, :, 1] = e[:, 0]
    for s in range(1, longest):
        k = live[s]
        for y in (0, 1):
            fwd[s, :k, y] = np.logaddexp(fwd[s - 1, :k, 0] + t[0, y], fwd[s - 1, :k, 1] + t[1, y]) + y * e[:k, s]
    for s in range(longest - 2, -1, -1):
        k = live[s + 1]
        for y in (0, 1):
            bwd[s, :k, y] = np.logaddexp(t[y, 0] + bwd[s + 1, :k, 0], t[y, 1] + e[:k, s + 1] + bwd[s + 1, :k, 1])
    log_z = np.logaddexp(fwd[sizes - 1, np.arange(len(order)), 0], fwd[sizes - 1, np.arange(len(order)), 1])
    pairs = np.zeros((2, 2))
    for s in range(longest - 1):
        k = live[s + 1]
        for a in (0, 1):
            for b in (0, 1):
                pairs[a, b] += np.exp(fwd[s, :k, a] + t[a, b] + b * e[:k, s + 1] + bwd[s + 1, :k, b] - log_z[:k]).sum()
    good = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - log_z)
    out: list[np.ndarray] = [np.zeros(0)] * len(order)
    for r, i in enumerate(order):
        out[i] = good[: sizes[r], r]
    return out, pairs, float(log_z.sum())


def fit(chains: list[np.ndarray], labels: list[int], steps: int = STEPS, penalty: float = PENALTY) -> LineModel:
    """Penalised maximum likelihood by gradient steps with momentum and
    per-weight scaling; the two kinds of document weigh the same lines."""
    full = [with_neighbours(x) for x in chains]
    width = 3 * len(FEATURES) + 2
    if len(set(labels)) < 2:
        return LineModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)))
    rows = np.vstack(full)
    mean, scale = rows.mean(0), np.maximum(rows.std(0), 1e-3)
    rows = (rows - mean) / scale
    edges = np.cumsum([len(x) for x in full])[:-1]
    y = np.repeat(labels, [len(x) for x in full]).astype(float)
    seen = np.zeros((2, 2))
    for x, label in zip(full, labels):
        seen[label, label] += len(x) - 1
    theta = np.zeros(width + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, bias, t = theta[:width], theta[width], theta[width + 1 :].reshape(2, 2)
        p, pairs, _ = chain_marginals(np.split(np.einsum("ij,j->i", rows, w) + bias, edges), t)
        gap = y - np.concatenate(p)
        grad = np.concatenate([np.einsum("ij,i->j", rows, gap), [gap.sum()], (seen - pairs).ravel()]) / len(y)
        grad -= penalty * np.concatenate([w, [0.0], 20 * t.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineModel(mean, scale, theta[:width], float(theta[width]), theta[width + 1 :].reshape(2, 2))


def fit_sample(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineModel:
    """Fit on at most ``FIT_DOCS`` of the labelled documents (``labels``:
    doc_id, quality)."""
    chosen = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([line_features(t)[0].ravel() for t in texts], dtype=object)

    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.join(F.broadcast(chosen), "doc_id").where(lines < FIT_LINES)  # at most FIT_DOCS rows
    # of texts with one id the least by hash, so every fit takes the same
    docs = docs.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = docs.select("doc_id", "quality", features(F.col("text")).alias("x"))
    rows = sorted(got.toPandas().itertuples(index=False), key=lambda r: r.doc_id)
    return fit([np.asarray(r.x).reshape(-1, len(FEATURES)) for r in rows], [int(r.quality) for r in rows])


def quality_column(text: Column, model: LineModel) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.qualities(texts))

    return score(text)


def classify(
    documents: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    out = documents.select(F.col(id_col).alias("doc_id"), quality_column(F.col(text_col), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
