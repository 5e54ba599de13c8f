"""Packing by power-of-two decomposition.

Each document is tokenized, ended with one end id, and cut into pieces whose
lengths are powers of two: as many pieces of ``max_len`` as fit, then the
binary digits of the rest, longest first.  Every piece is a sequence of its
own, so no sequence crosses documents and none needs padding; pieces of equal
length share a ``bucket`` (log2 of the length), from which batches of one
shape are drawn.

There is no shuffle: a document is tokenized and cut where it is read.
``sequence_id`` comes from the partition and the position in it, which a
recomputed task gives again.

Defined cases: a null or empty text is one piece holding the end id; a null
id is carried; repeated rows are packed once each, with their own sequences;
other columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAX_LEN = 2048

#: Words kept in a worker's table of ids, in two halves.
CACHE_WORDS = 400_000

# Text of these characters only needs no Unicode normalisation, and its white
# space is the same for Python and the tokenizer; other texts take the
# tokenizer's own full path.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa0-ɏ]*")
# The vocabulary's word pattern (fixed by its file), for plain characters.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\s\w]|_)+")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: its own if it prints, else the
    next free one from 256."""
    free = itertools.count(256)
    return {b: b if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else next(free) for b in range(256)}


class _Newer(dict):
    """The newer half of a table; a word that it lacks is asked for once."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, word: str) -> bytes:
        return self.find(word)


class WordIds:
    """Token ids of a text as little-endian uint32 bytes.  Parts of a word
    never cross white space, so ids are looked up word by word.  The table has
    a newer and an older half: when the newer one is full it becomes the older
    one, and words still in use move over."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = _Newer(self._find)
        self.older: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        ids = self.ids
        return b"".join([ids[t.id] for t in self.model.tokenize(part)])

    def _find(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            # letters alone are one part
            parts = () if word.isalpha() else _PARTS.findall(word)
            out = self._part(word) if len(parts) < 2 else b"".join([self.words[p] for p in parts])
        if len(word) <= 64:
            if len(self.words) >= CACHE_WORDS // 2:
                self.older = dict(self.words)
                self.words.clear()
            self.words[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or "<|" in text and any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.lower().split()))


@functools.lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """``max_len`` as often as it fits, then the binary digits of the rest."""
    whole, rest = divmod(n, max_len)
    return [max_len] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def token_ids(vocabulary: str | None = None, end_id: int = END_ID):
    """Column function: the ids of a text with the end id, as bytes."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        ids = _word_ids(vocabulary or vocabulary_path())
        end = np.asarray([end_id], dtype="<u4").tobytes()
        return pd.Series([ids.encode(t or "") + end for t in texts], dtype=object)

    return encode


def pack(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = MAX_LEN,
    vocabulary: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (little-endian uint32
    bytes), ``doc_tokens, bucket, sequence_id, offset``."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    b = max_len.bit_length() - 1
    docs = documents.select(F.col(id_col).alias("doc_id"), token_ids(vocabulary, end_id)(F.col(text_col)).alias("ids"))
    docs = docs.withColumn("doc_tokens", (F.octet_length("ids") / 4).cast("long"))
    # start and length of every piece, from the binary digits of doc_tokens
    whole = F.expr(f"transform(sequence(0L, doc_tokens div {max_len}), i -> struct(i * {max_len}L AS start, {max_len}L AS length))")
    whole = F.slice(whole, F.lit(1), (F.col("doc_tokens") / max_len).cast("int"))
    rest = F.expr(
        f"transform(filter(sequence({b - 1}, 0, -1), k -> (shiftright(doc_tokens, k) & 1) = 1), "
        "k -> struct(shiftleft(shiftright(doc_tokens, k + 1), k + 1) AS start, shiftleft(1L, k) AS length))"
    ) if b else F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")
    pieces = docs.select("doc_id", "ids", "doc_tokens", F.explode(F.concat(whole, rest)).alias("p"))
    return pieces.select(
        "doc_id",
        F.col("p.start").alias("start"),
        F.col("p.length").alias("length"),
        F.expr("substring(ids, cast(p.start * 4 + 1 as int), cast(p.length * 4 as int))").alias("ids"),
        "doc_tokens",
        F.log2(F.col("p.length")).cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences with one folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)
