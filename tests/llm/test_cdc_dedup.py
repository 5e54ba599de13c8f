import random

import xxhash

from llm_data import SF_MID
from tablewright.llm import cdc_dedup, queries
from tablewright.llm.cdc_dedup import GEAR, MAX_BYTES, MEAN_BITS, MIN_BYTES, MIN_RUN


def slow_cuts(data):
    """One byte at a time."""
    h, start, out = 0, 0, []
    for i, b in enumerate(data):
        h = (h * 2 + int(GEAR[b])) % (1 << 32)
        size = i + 1 - start
        if size >= MIN_BYTES and h >> (32 - MEAN_BITS) == 0 or size == MAX_BYTES and i + 1 < len(data):
            out.append(i + 1)
            start = i + 1
    return out + [len(data)] * (start < len(data))


def slow(rows):
    """Spans of each row, by its number."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    seen, out = set(), {}
    for r in order:
        data, at, gone = (rows[r][1] or "").encode(), 0, []
        for end in slow_cuts(data):
            digest = xxhash.xxh3_128_digest(data[at:end])
            if end - at >= MIN_BYTES:
                if digest in seen:
                    gone[-1:] = [(gone[-1][0], end)] if gone and gone[-1][1] == at else [*gone[-1:], (at, end)]
                seen.add(digest)
            at = end
        out[r] = [(a, b) for a, b in gone if b - a >= MIN_RUN or (a, b) == (0, len(data))]
    return out


def by_id(texts):
    return {texts[r][0]: ",".join(f"{a}:{b}" for a, b in spans) for r, spans in slow(texts).items()}


def test_gear_cuts_match_the_rolling_form():
    rng = random.Random(1)
    for n in (0, 1, 10, 31, 33, 700, 5000):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert cdc_dedup.cuts(data) == slow_cuts(data)
    assert cdc_dedup.cuts(b"a" * 2000) == slow_cuts(b"a" * 2000)


def test_query_matches_brute_force(spark, texts):
    want = by_id(texts)
    rows = queries.op7_cdc_dedup(spark, SF_MID).collect()
    assert {r.doc_id: r.spans for r in rows} == want
    assert any(r.n_removed for r in rows) and all(r.n_removed <= r.n_bytes for r in rows)


def test_insertions_move_cuts_locally():
    rng = random.Random(9)
    data = bytes(rng.randrange(32, 127) for _ in range(20_000))
    chunks = lambda d: {d[a:b] for a, b in zip([0, *cdc_dedup.cuts(d)], cdc_dedup.cuts(d))}
    assert len(chunks(data) - chunks(data[:5000] + b"inserted" + data[5000:])) <= 4


def test_passages_of_a_few_sentences_are_found(spark):
    # passages of 51 to 80 words, each put into two texts of their own
    rng = random.Random(3)
    vocab = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 10))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    passages = [text(rng.randrange(51, 81)) for _ in range(300)]
    put = lambda p: f"{text(rng.randrange(40))} {p} {text(rng.randrange(40))}"
    rows = [(i, put(p)) for i, p in enumerate(passages * 2)] + [(1000 + i, text(200)) for i in range(300)]
    got = {r.doc_id: r.n_removed for r in cdc_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert not any(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(300))
    # at least half of the passage goes from the later text, and never more than it
    assert all(got[300 + i] <= len(p) + 2 for i, p in enumerate(passages))
    assert sum(2 * got[300 + i] >= len(p) for i, p in enumerate(passages)) >= 0.85 * 300


def test_odd_rows(spark, odd):
    extra = odd.union(odd.where("doc_id = 4")).selectExpr("*", "1 AS d", "2 AS s")
    got = cdc_dedup.dedup(extra).collect()
    rows = [(r.doc_id, r.text) for r in extra.collect()]
    want = slow(rows)
    expected = [(i, len((t or "").encode()), want[r]) for r, (i, t) in enumerate(rows)]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.n_bytes, [(s.s, s.e) for s in r.spans])) for r in got)
    # of rows repeated under one id, or without an id, one copy stays
    again = spark.createDataFrame([(i, "the very same text, twice and more, under one id or under none at all") for i in (7, 7, 7, None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in cdc_dedup.dedup(again).collect())[:2] == [0, 69]
    assert cdc_dedup.dedup(odd.limit(0)).count() == 0
    both = cdc_dedup.dedup(odd).where("doc_id = 5").first()
    assert both.n_removed > 0.9 * both.n_bytes


def test_hot_digests_give_the_same_result(spark, texts, monkeypatch):
    want = by_id(texts)
    monkeypatch.setattr(cdc_dedup, "hot_digests", lambda one: one.where("high > 0").select("high").distinct())
    assert {r.doc_id: r.spans for r in queries.op7_cdc_dedup(spark, SF_MID).collect()} == want


def test_hot_digests_are_found_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(cdc_dedup, "HOT_SAMPLE", 2)
    share = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = spark.range(20_000).selectExpr("if(id % 3 = 0, 7, id) AS high")
    assert [r.high for r in cdc_dedup.hot_digests(one).collect()] == [7]
    even = spark.range(20_000).selectExpr(f"id % {3 * share} AS high")
    assert cdc_dedup.hot_digests(even).count() == 0
    assert cdc_dedup.hot_digests(one.limit(0)).count() == 0
