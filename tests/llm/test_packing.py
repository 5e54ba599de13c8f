import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm_data import SF_MID
from tablewright.llm import packing, queries


def test_query_matches_the_tokenizer(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in texts}
    seen, rows = {}, queries.op2_packing(spark, SF_MID).collect()
    for r in rows:
        part = np.asarray(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and len(part) == 4 * r.length
        assert r.doc_tokens == len(ids[r.doc_id]) and r.offset == 0
        assert r.length <= 2048 and r.length & (r.length - 1) == 0
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    assert len({r.sequence_id for r in rows}) == len(rows)
    for d, x in ids.items():
        parts = sorted(seen[d])
        assert [s for s, _ in parts] == list(np.cumsum([0] + [n for _, n in parts[:-1]])) and sum(n for _, n in parts) == len(x)


def test_words_match_the_tokenizer_with_a_small_table(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    words = packing.WordIds(packing.vocabulary_path())
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(160, 0x250)]]
    often = [*"aeiou'.,-  19", "'s", "'ll", "é", "ß"]
    texts = letters + [f"a{c}b 1{c}2 '{c} {c}{c}" for c in letters]
    texts += ["".join(rng.choice(often if rng.random() < 0.8 else letters) for _ in range(rng.randrange(1, 200))) for _ in range(3000)]
    for text in texts + texts[:500]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert len(words.words) <= 20 and len(words.older) <= 20


def test_piece_lengths():
    assert packing.piece_lengths(2048 * 2 + 1024 + 5) == [2048, 2048, 1024, 4, 1]
    assert packing.piece_lengths(1) == [1]


def test_odd_rows(odd):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(odd).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    got = {}
    for r in sorted((r for r in rows if r.doc_id in (2, 3, 4, 6, 7, 8, 9)), key=lambda r: r.start):
        got[r.doc_id] = got.get(r.doc_id, b"") + r.ids
    for r in odd.where("doc_id IN (2, 3, 4, 6, 7, 8, 9)").collect():
        want = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(got[r.doc_id], "<u4").tolist() == want
    assert packing.pack(odd.limit(0)).count() == 0
    small = packing.pack(odd, max_len=1)
    assert {r.length for r in small.where("doc_id = 1").collect()} == {1}


def test_buckets_hold_one_length(odd, spark, tmp_path):
    packing.write_buckets(packing.pack(odd), str(tmp_path / "b"))
    for r in spark.read.parquet(str(tmp_path / "b")).select("bucket", "length").distinct().collect():
        assert r.length == 1 << r.bucket


def test_a_known_word_is_one_lookup(monkeypatch):
    """Each distinct word is worked out once, words of letters without the
    word pattern; a text of known words asks the table only."""
    words = packing.WordIds(packing.vocabulary_path())
    calls, find = [], words._part
    monkeypatch.setattr(words, "_part", lambda p: calls.append(p) or find(p))
    rng = random.Random(4)
    text = [f"{''.join(rng.choices('aeioulnrst', k=9))}{'.' if i % 5 == 0 else ''}" for i in range(150_000)]
    ids = [words.encode(" ".join(text[i : i + 1000])) for i in range(0, len(text), 1000)]
    asked = len(calls)
    assert asked <= len({t.rstrip(".") for t in text}) + 1
    assert [words.encode(" ".join(text[i : i + 1000])) for i in range(0, len(text), 1000)] == ids
    assert len(calls) == asked
