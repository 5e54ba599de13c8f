import random

import numpy as np
import pytest
import xxhash

from llm_data import SF_MID
from tablewright.llm import queries, simhash
from tablewright.llm.components import components


def slow_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def classes(fps, radius):
    """Component label of every distinct fingerprint, by all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_query_matches_brute_force(spark, texts):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF_MID).collect()}
    fps = {d: slow_fingerprint(t) for d, t in texts}
    label, least = classes(fps.values(), 4), {}
    for d, f in fps.items():
        least[label[f]] = min(d, least.get(label[f], d))
    assert got == {(d, f"{f:016x}", least[label[f]]) for d, f in fps.items()}


def cluster(rng, n, flips):
    centre = rng.getrandbits(64)
    out = {centre}
    while len(out) < n:
        f = rng.choice([centre, *list(out)[:20]])
        for b in rng.sample(range(64), rng.randint(1, flips)):
            f ^= 1 << b
        out.add(f)
    return out


def test_bucket_forest_is_exact_for_any_radius():
    rng = random.Random(3)
    fps = np.array(sorted(cluster(rng, 300, 4) | cluster(rng, 200, 6) | {rng.getrandbits(64) for _ in range(400)}), dtype=np.uint64)
    for radius in (0, 1, 3, 4, 7, 11):
        got = {int(f): int(f) for f in fps} | dict(simhash.bucket_forest(fps, radius))
        assert got == classes([int(f) for f in fps], radius)


def test_links_lose_nothing_for_any_key_plan(spark, monkeypatch):
    rng = random.Random(5)
    fps = sorted(cluster(rng, 250, 5) | cluster(rng, 60, 4) | {rng.getrandbits(64) for _ in range(300)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {f: r for f, r in classes(fps, 4).items() if f != r}
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 50)  # forces pairs of chunks
    for n in (600, 1 << 30):  # one block, several blocks
        links = simhash.fingerprint_links(df, n, 4).collect()
        roots = classes_from_links(fps, [(r.a % (1 << 64), r.b % (1 << 64)) for r in links])
        assert {f: r for f, r in roots.items() if f != r} == want


def classes_from_links(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("few", [200_000, 0])  # with broadcasts, and by joins alone
def test_components_of_paths_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr("tablewright.llm.components.FEW_LINKS", few)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 299)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 30)} | {300: 299}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[2].fp == 0 and by_id[2].component_id == by_id[3].component_id == by_id[7].component_id == 2
    assert by_id[4].component_id == by_id[5].component_id == 4
    assert sorted(str(r.component_id) for r in rows if r.doc_id is None) == ["1", "2"]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
