import hashlib
import random
import re
import zlib

import duckdb
import pytest

from llm_data import SF_MID, bag
from tablewright.llm import prefix_trie, queries
from tablewright.operators.running import running
from pyspark.sql import functions as F

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Nodes of the trie by walking whole conversations (turns told apart by
    their numbers)."""
    own = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        if conv is not None:
            own.setdefault(conv, []).append((role or "", text or ""))
    seqs = {}
    for c, turns in own.items():
        h, first = zlib.crc32(str(c).encode()) % 4, c - int(c / 20) * 0 - (abs(c) % 20) * (1 if c >= 0 else -1)
        seqs[c] = own.get(first, [])[:h] + turns[h:]
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        yield k
        for x in kids.get(k, []):
            yield from below(x)

    out = []
    for k, m in members.items():
        sub = list(below(k))
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in sub if x)
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), sum(x not in kids for x in sub), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, node int, digest string")
    got = prefix_trie.prefix_trie(df.repartition(5))
    assert got.columns == NAMES
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_MID}/conversations.parquet'")
    want = db.execute(queries.ORACLE["op13_prefix_trie"])
    names, rows = [d[0] for d in want.description], want.fetchall()
    got = queries.op13_prefix_trie(spark, SF_MID)
    assert bag(got.columns, got.collect()) == bag(names, rows) and len(rows) > 300


@pytest.mark.parametrize("solve, piece", [(prefix_trie.SOLVE_ARCS, 4096), (12, 3)])
def test_trie_matches_plain_version(spark, monkeypatch, solve, piece):
    """Also with the list contracted to a few arcs, and hashes in small pieces."""
    monkeypatch.setattr(prefix_trie, "SOLVE_ARCS", solve)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", piece)
    rng, rows = random.Random(solve), []
    for c in [*range(0, 90), *rng.sample(range(200, 5000), 60), *range(-45, -5)]:
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), " ".join(rng.choices(["a", "b ", "ü\tx"], k=rng.choice([0, 1, 1, 2])))))
    rows += [(c, t, "user", "the same") for c in range(6000, 6040) for t in range(3)]  # one large group of copies
    rows += [(7000, t, "user", str(t % 3)) for t in range(400)]  # a long conversation
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "x"), (1, 0, None, None), (1, 1, "", ""), (2, None, "user", "null first"), (2, 5, "user", "later"),
        (20, 0, "user", "z" * 300_000), (21, 0, "user", "z" * 300_000), (22, 0, "user", "a\nb"), (-21, 0, "user", "y"), (-20, 0, "user", "first"),
        (9223372036854775807, 0, "user", "q"), (41, 0, "u", "serx"), (42, 0, "us", "erx"), (43, 3, "user", "x"), (44, 1, "user", "x"),
    ]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == [] and run(spark, [(None, 0, "user", "x")]) == []
    assert run(spark, [(60, 0, "user", "one")]) == plain([(60, 0, "user", "one")])
    # repeated rows are turns of their own, in whatever order
    again = [(60, 0, "user", "one two")] * 3
    assert [r[:7] for r in run(spark, again)] == [r[:7] for r in plain([(60, i, "user", "one two") for i in range(3)])]


def test_running_totals_in_one_large_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4500, 0).otherwise(F.col("id") % 7).alias("g"), "id", F.xxhash64("id").alias("x"))
    got = running(df.repartition(6), ["g"], ["id"], {"n": ("sum", F.lit(1).cast("long")), "h": ("xor", F.col("x"))})
    seen = {}
    for r in sorted(got.collect(), key=lambda r: (r.g, r.id)):
        n, h = seen.get(r.g, (0, 0))
        seen[r.g] = (n + 1, h ^ r.x)
        assert (r.n, r.h) == seen[r.g]
    assert got.columns == ["g", "id", "x", "n", "h"]
