"""Secret scans by token efficiency.

A tokenizer's vocabulary covers written language with long tokens; random
strings fall apart into short ones.  A run of key characters that holds
letters is reported when it has few characters for each token (``max_ratio``),
unless it is a known digest (hex of a digest's length), a UUID or an
identifier: segments between ``-_/+=`` of letters, then digits, whose letters
tokenize like words.  If words make a run efficient, what stands between them
is tested by itself.  Three patterns for known forms (assignments, access keys,
long hex) are always reported.

One pass over the rows, no shuffle.  Defined cases: a null or empty text has
no spans; repeated rows are scanned each; ids are not looked at.
"""
from __future__ import annotations

import functools
import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")

MIN_CHARS = 16
MAX_RATIO = 2.3

# The patterns of the known forms and their least lengths.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_RUN = re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % MIN_CHARS)
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_SEGMENT = re.compile(r"[A-Za-z0-9]+")
_NAME = re.compile(r"([A-Za-z]*)\d*")
_SHORT_NAME = 3
_FEW = 8  # fewer letters than these tokenize like a word at _WORD_RATIO, others at max_ratio
_WORD_RATIO = 2.0


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """Digests and UUIDs, which are no secrets."""
    return len(run) in _DIGEST_LENGTHS and bool(_HEX_ONLY.fullmatch(run)) or bool(_UUID.fullmatch(run))


def random_parts(run: str, encoding, max_ratio: float = MAX_RATIO) -> list[tuple[int, int]]:
    """Places of the random strings in a run: the run, or else what stands
    between its words, or else single segments."""

    def ratio(part: str) -> float:
        return len(part) / len(encoding.encode_ordinary(part))

    def kind(part: str) -> str:
        name = _NAME.fullmatch(part)
        letters = name[1] if name else ""
        if not name or len(letters) <= _SHORT_NAME:
            return "short" if name else "odd"
        least = _WORD_RATIO if len(letters) < _FEW else max_ratio
        return "word" if ratio(letters.lower() if letters.isupper() else letters) >= least else "odd"

    def random(a: int, b: int) -> bool:
        part = run[a:b]
        return b - a >= MIN_CHARS and any(map(str.isalpha, part)) and not is_known(part) and ratio(part) < max_ratio

    segments = [(*m.span(), kind(m[0])) for m in _SEGMENT.finditer(run)]
    if is_known(run) or all(k != "odd" for _, _, k in segments):
        return []
    if random(0, len(run)):
        return [(0, len(run))]
    out, between = [], []
    for a, b, k in [*segments, (0, 0, "word")]:
        if k != "word":
            between.append((a, b, k))
            continue
        odd = [i for i, x in enumerate(between) if x[2] == "odd"]
        if odd:
            inner = between[odd[0] : odd[-1] + 1]
            for x in (between, inner):
                if random(x[0][0], x[-1][1]):
                    out.append((x[0][0], x[-1][1]))
                    break
            else:
                out += [(a, b) for a, b, k in inner if k == "odd" and random(a, b)]
        between = []
    return out


def spans(text: str, encoding, max_ratio: float = MAX_RATIO) -> list[str]:
    """``kind:start:end`` (code points, end exclusive) by start, then kind."""
    low, found = text.lower(), []
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    starts, reach = [s for s, _, _ in found], [0, *accumulate((e for _, _, e in found), max)]

    def covered(a: int, b: int) -> bool:  # by one base span: of those that start at a or before, the furthest end decides
        return reach[bisect_right(starts, a)] >= b

    for m in _RUN.finditer(text):
        a, b = m.span()
        if m[0].isdigit() or covered(a, b):
            continue
        for x, y in random_parts(m[0], encoding, max_ratio):
            if not covered(a + x, a + y):
                found.append((a + x, 3, a + y))
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def secret_spans(text: Column, max_ratio: float = MAX_RATIO, vocabulary: str | None = None) -> Column:
    """Column of ``array<string>``: the spans of a text."""

    @F.pandas_udf("array<string>")
    def scan(texts: pd.Series) -> pd.Series:
        import public_tokenizers

        encoding = _encoding(vocabulary or public_tokenizers.path(VOCABULARY))
        return pd.Series([spans(t, encoding, max_ratio) if t else [] for t in texts], dtype=object)

    return scan(text)


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """``doc_id, spans`` for every row."""
    return documents.select(F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col), max_ratio).alias("spans"))


def redact(text: Column, max_ratio: float = MAX_RATIO, mark: str = "[secret]") -> Column:
    """The text with every span (overlapping ones together) replaced by ``mark``."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        import public_tokenizers

        encoding = _encoding(public_tokenizers.path(VOCABULARY))
        return pd.Series([t if not t else replace_spans(t, spans(t, encoding, max_ratio), mark) for t in texts], dtype=object)

    return cut(text)


def replace_spans(text: str, found: list[str], mark: str) -> str:
    out, end = [], 0
    for a, b in (map(int, s.split(":")[1:]) for s in found):
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])
