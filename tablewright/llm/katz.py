"""Katz backoff language model.

Counts of words and of word pairs are discounted by Good-Turing; counts over
``KEEP`` lose ``SLIGHT`` only, so that every context frees some mass.  What a context's pairs give up is shared over the words
not seen after it in proportion to their own probability, with a backoff
weight that makes every context's probabilities sum to one.  The words' own
freed mass goes to one unknown word.  A token is scored by the pair table and,
where the pair is missing, by the context's backoff weight and the word table.

Tokens stay packed: documents are read in blocks, a block holds its tokens as
indices of its distinct words, and asks the count tables, partitioned by key
hash, once for each distinct key.  A partition adds the counts of all blocks
and answers each; the first block that trained a pair counts it in its
context's sums.  So rows are exchanged once for each distinct key of a block,
not for each token, and no key is hot: every block sends it once.  A block is
small enough that the arrays over its tokens stay a few MB each; sorted keys
travel as six bytes each and the steps of the other two.

Keys are 64-bit hashes of words and of pairs.  Defined cases: a null or empty
text is its end token alone; repeated rows are trained on and scored each;
without training rows every word is unknown with probability one; other
columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stage

KEEP = 5
SLIGHT = 0.01
BLOCK_TOKENS = 500_000
PART_BYTES = 8 << 20

_BEGIN = np.uint64(0x243F6A8885A308D3)
_MIX = np.uint64(0x9E3779B97F4A7C15)

WORD, PAIR = 0, 1


def _pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of pairs; both arrays are overwritten."""
    x, w = before, words
    w ^= w >> np.uint64(31)
    x *= _MIX
    x += w
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return x


def _pack(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, dtype=kind).tobytes()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: how many, the high two bytes of the first, the low six
    bytes of each, the steps of the high two."""
    high = (keys >> np.uint64(48)).astype(np.int64)
    low = _pack(keys, "<u8")
    low = np.frombuffer(low, "u1").reshape(-1, 8)[:, :6]
    return _pack([len(keys), *high[:1]], "<i8") + _pack(low, "u1") + _small(np.diff(high)) if len(keys) else b""


def _unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, first = np.frombuffer(data, "<i8", 2).tolist()
    keys = np.zeros((n, 8), "u1")
    keys[:, :6] = np.frombuffer(data, "u1", 6 * n, 16).reshape(n, 6)
    keys = keys.view("<u8").ravel()
    high = np.cumsum(np.append(first, _unsmall(data[16 + 6 * n :])))
    keys |= high.astype(np.uint64) << np.uint64(48)
    return keys


class _Words(dict):
    """Hash of a word; the table is emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


BLOCKS = "block long, ids array<long>, tokens long, train binary, lengths binary, words binary, index binary"

#: Rows of a batch that are Python objects at one time.
SLICE_ROWS = 200


def _slices(batch: pa.RecordBatch, rows: int):
    """The batch's rows as dictionaries, few at a time."""
    for i in range(0, batch.num_rows, rows):
        yield from batch.slice(i, rows).to_pylist()


def _record(row: tuple, ddl: str) -> pa.RecordBatch:
    """A batch of one row, whose columns are long, binary or array<long>."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([x], kinds[c.split()[1]]) for x, c in zip(row, ddl.split(", "))], _names(ddl))


def blocks(documents: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """Documents in blocks of about ``BLOCK_TOKENS`` tokens: ids, training
    flags, lengths with the end token, hashes of the distinct words
    and the tokens as their indices."""

    def run(batches):
        import uuid

        hashes, held = _Words(), []

        def flush():
            tokens = np.concatenate([h for _, _, h in held])
            words, index = np.unique(tokens, return_inverse=True)
            row = (
                uuid.uuid4().int >> 65, [i for i, _, _ in held], len(tokens), _pack([t for _, t, _ in held], "u1"),
                _pack([len(h) for _, _, h in held], "<i8"), _pack_keys(words), _pack(index & 0xFFFF, "<u2") + _small(index >> 16),
            )
            held.clear()
            return _record(row, BLOCKS)

        end, size = _Words()[b"\xff end"], 0
        for batch in batches:
            for r in _slices(batch, SLICE_ROWS):
                h = np.array([hashes[w] for w in (r["text"] or "").encode().lower().split()] + [end], dtype=np.uint64)
                held.append((r["id"], r["train"], h))
                size += len(h)
                if size >= BLOCK_TOKENS:
                    size = 0
                    yield flush()
        if held:
            yield flush()

    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, BLOCKS)


@dataclass
class _Block:
    ids: list
    lengths: np.ndarray
    words: np.ndarray
    index: np.ndarray  # word of every token
    before: np.ndarray  # word before it, the number of words at a beginning
    taught: np.ndarray  # whether the token is in a training document
    doc: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        contexts = np.append(self.words, _BEGIN)
        return np.unique(_pair_keys(contexts[self.before], self.words[self.index]), return_inverse=True)


def _open(r: dict) -> _Block:
    words = _unpack_keys(r["words"])
    index = np.frombuffer(r["index"], "<u2", r["tokens"]).astype(np.int32)
    index |= _unsmall(r["index"][2 * len(index) :]).astype(np.int32) << 16
    lengths = np.frombuffer(r["lengths"], "<i8")
    before = np.empty_like(index)
    before[1:] = index[:-1]
    before[(np.cumsum(lengths) - lengths)] = len(words)
    train = np.frombuffer(r["train"], "u1").astype(bool)
    return _Block(
        list(r["ids"]), lengths, words, index, before, np.repeat(train, lengths), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    )


def _partition_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


ASKED = "level int, part long, block long, keys binary, counts binary"


def _ask(parts: int):
    """Distinct keys of a block with their counts in its training documents,
    cut by partition; keys are sorted, so a partition is a range of them.
    Words are fewer than pairs and have a third of the partitions."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def cut(block: int, level: int, parts: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = _partition_of(keys, parts)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(keys)]))
        rows = [(level, int(part[i]), block, _pack_keys(keys[i:j]), _small(counts[i:j])) for i, j in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _names(ASKED))

    def asked(r: dict) -> list[pa.RecordBatch]:
        b = _open(r)
        words = cut(r["block"], WORD, max(1, parts // 3), b.words, np.bincount(b.index[b.taught], minlength=len(b.words)))
        keys, inverse = b.pairs()
        return [words, cut(r["block"], PAIR, parts, keys, np.bincount(inverse[b.taught], minlength=len(keys)))]

    def run(batches):
        for batch in batches:
            for r in _slices(batch, 1):
                yield from asked(r)

    return run


def _small(counts: np.ndarray) -> bytes:
    """Counts as compressed bytes; most are 0 or 1."""
    import zlib

    top = int(counts.max(initial=0))
    kind = "u1" if top < 256 else "<u4" if top < 1 << 32 else "<u8"
    return kind.encode()[-1:] + zlib.compress(_pack(counts, kind), 1)


def _unsmall(data: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(data[1:]), {b"1": "u1", b"4": "<u4", b"8": "<u8"}[data[:1]]).astype(np.int64)


ANSWERED = "level int, part long, block long, totals binary, own binary, hist array<long>"


def _answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of a partition's keys for every block, whether the block is the
    first that trained the key, and (in the first row) how many keys have
    each count up to KEEP + 1, all keys and all counts."""
    rows = rows.sort_values("block")
    keys = [_unpack_keys(k) for k in rows["keys"]]
    counts = [_unsmall(c) for c in rows["counts"]]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    flat = np.concatenate(counts)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, inverse, flat)
    trained = np.flatnonzero(flat)
    first = np.zeros(len(flat), bool)
    first[trained[np.unique(inverse[trained], return_index=True)[1]]] = True
    hist = np.append(np.bincount(np.minimum(totals, KEEP + 2), minlength=KEEP + 3)[1 : KEEP + 2], [(totals > 0).sum(), totals.sum()])
    out, at = [], 0
    for block, k in zip(rows["block"], keys):
        part = slice(at, at + len(k))
        out.append((int(key[0]), int(key[1]), block, _small(totals[inverse[part]]), _small(first[part]), hist.tolist() if at == 0 else None))
        at += len(k)
    return pd.DataFrame(out, columns=_names(ANSWERED))


def discounts(of_count: list[int], keep: int = KEEP) -> np.ndarray:
    """Good-Turing discount factors for counts 0 to ``keep``.
    ``of_count[c - 1]``: number of keys with count c.  Where the counts of
    counts give no factor between 0 and 1, half a count is taken off."""
    d = np.ones(keep + 2)
    n, d = [0, *of_count], np.ones(keep + 1)
    common = (keep + 1) * n[keep + 1] / n[1] if n[1] else 1.0
    for c in range(1, keep + 1):
        ratio = (c + 1) * n[c + 1] / (c * n[c]) if n[c] else 0.0
        x = (ratio - common) / (1 - common) if common < 1 else 0.0
        d[c] = x if 0 < x < 1 else 1 - 0.5 / c
    return d


def kept(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.where(c < len(d), d[np.minimum(c, len(d) - 1)] * c, c - SLIGHT)


@dataclass
class Model:
    """Global figures: tokens N, types V, discounts of words and of pairs,
    and the unknown word's probability."""

    tokens: int
    types: int
    words: np.ndarray
    pairs: np.ndarray
    unknown: float

    def word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, kept(self.words, c) / max(1, self.tokens), self.unknown)


def model_of(hists: dict[int, np.ndarray]) -> Model:
    words, pairs = (hists.get(k, np.zeros(KEEP + 3, np.int64)) for k in (WORD, PAIR))
    d, types, tokens = discounts(words[: KEEP + 1].tolist()), int(words[-2]), int(words[-1])
    rare = words[:KEEP]
    freed = ((1 - d[1:]) * np.arange(1, KEEP + 1) * rare).sum() + SLIGHT * (types - rare.sum())
    return Model(tokens, types, d, discounts(pairs[: KEEP + 1].tolist()), float(freed / tokens) if tokens else 1.0)


SCORED = "kind int, block long, row int, id long, key long, n long, known long, base double, score double"
DOC, PENDING, CONTEXT = 0, 1, 2


def _score(model: Model):
    """Per block: the documents' scores as far as the block knows them; the
    tokens that wait for a backoff weight, by document and context; the sums
    of contexts over the pairs that this block counts."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b = _open(left.iloc[0].to_dict())
        right = right.sort_values(["level", "part"])
        word_total, pair_total = (np.concatenate([_unsmall(x) for x in right["totals"][right["level"] == k]]) for k in (WORD, PAIR))
        first = np.concatenate([_unsmall(x) for x in right["own"][right["level"] == PAIR]]).astype(bool)
        inverse = b.pairs()[1]
        p_word, p_pair, docs = model.word(word_total), kept(model.pairs, pair_total), len(b.ids)
        # a word is followed as often as it occurs, a beginning as often as an end occurs
        context = np.append(b.words, _BEGIN).view(np.int64)
        context_total = np.append(word_total, word_total[b.index[-1]])

        at = np.unique(inverse, return_index=True)[1][first]
        follows = lambda x: np.bincount(b.before[at], x, len(context))
        has = np.flatnonzero(follows(None))
        sums = pd.DataFrame({
            "key": context[has], "n": follows(pair_total[first])[has], "base": follows(p_pair[first])[has], "score": follows(p_word[b.index[at]])[has]
        })

        seen = (pair_total > 0)[inverse]
        p = np.where(seen, p_pair[inverse] / np.maximum(context_total, 1)[b.before], p_word[b.index])
        done = pd.DataFrame({
            "row": np.arange(docs), "id": pd.Series(b.ids, dtype=object), "n": b.lengths,
            "known": np.bincount(b.doc, (word_total > 0)[b.index], docs).astype(np.int64),
            "base": np.bincount(b.doc, np.log10((word_total + 1) / (model.tokens + model.types + 1))[b.index], docs),
            "score": np.bincount(b.doc, np.log10(p), docs),
        })
        wait = np.flatnonzero(~seen & (context_total > 0)[b.before])
        pair, n = np.unique(b.doc[wait].astype(np.int64) * len(context) + b.before[wait], return_counts=True)
        pend = pd.DataFrame({"row": pair // len(context), "key": context[pair % len(context)], "n": n})
        out = [done.assign(kind=DOC, key=0), pend.assign(kind=PENDING, id=None, known=0, base=0.0, score=0.0), sums.assign(kind=CONTEXT, row=0, id=None, known=0)]
        out = pd.concat([x.assign(block=key[0])[_names(SCORED)] for x in out if len(x)])
        return out.astype({"kind": "int32", "row": "int32", "key": "int64", "n": "int64", "known": "int64"})

    return run


def score(documents: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """``doc_id, n_tokens, n_known, base_score, score`` for every row (log10),
    and the global figures.  ``train`` is a condition on ``documents``."""
    read = stage(blocks(documents, train, id_col, text_col), "blocks")
    tokens = read.agg(F.sum("tokens")).first()[0]
    parts = max(1, -(-8 * int(tokens or 0) // PART_BYTES))
    asked = read.mapInArrow(_ask(parts), ASKED)
    answered = stage(asked.groupBy("level", "part").applyInPandas(_answer, ANSWERED), "totals")
    hists: dict[int, np.ndarray] = {}
    for level, i, n in (
        answered.select("level", F.posexplode("hist").alias("i", "n")).groupBy("level", "i").agg(F.sum("n")).collect()
    ):
        hists.setdefault(level, np.zeros(KEEP + 3, np.int64))[i] = n
    model = model_of(hists)
    parted = read.groupBy("block").cogroup(answered.drop("hist").groupBy("block")).applyInPandas(_score(model), SCORED)
    parted = stage(parted, "scored")
    wait = parted.where(F.col("kind") == PENDING).select("block", "row", "key", "n").join(backoff(parted), "key")
    wait = wait.groupBy("block", "row").agg(F.sum(F.col("n") * F.col("log_alpha")).alias("more"))
    docs = parted.where(F.col("kind") == DOC).join(wait, ["block", "row"], "left")
    return docs.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.col("base").alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    ), model


def backoff(parted: DataFrame) -> DataFrame:
    """Backoff weight of every context, as ``key, log_alpha`` (log10): the
    freed mass over the mass of the words not seen after it."""
    sums = parted.where(F.col("kind") == CONTEXT).groupBy("key").agg(
        F.sum("n").alias("c"), F.sum("base").alias("kept"), F.sum("score").alias("mass")
    )
    return sums.select("key", F.log10((1 - F.col("kept") / F.col("c")) / (1 - F.col("mass"))).alias("log_alpha"))
