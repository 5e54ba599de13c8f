import duckdb
import re

from pyspark.sql import functions as F

from llm_data import SF_MID, bag
from tablewright.llm import decontaminate, queries


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')")
    res = con.execute(queries.ORACLE["op3_decontaminate"])
    df = queries.op3_decontaminate(spark, SF_MID)
    rows = [tuple(r) for r in df.collect()]
    assert any(r[2] for r in rows)
    assert bag(df.columns, rows) == bag([c[0] for c in res.description], res.fetchall())


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(doc, items, size=13):
    """Words, hit words and sorted item ids, by looking up every n-gram."""
    windows = {}
    for i, t in items:
        w = words_of(t)
        for at in range(max(0, len(w) - size) + 1) if w else ():
            windows.setdefault(tuple(w[at : at + size]), set()).add(i)
    words, hit, named = words_of(doc), set(), set()
    for n in {len(w) for w in windows}:
        for p in range(len(words) - n + 1):
            ids = windows.get(tuple(words[p : p + n]))
            if ids:
                hit |= set(range(p, p + n))
                named |= {str(i) for i in ids if i is not None}
    return len(words), len(hit), sorted(named)


def test_words_are_split_without_copies_of_the_text(spark):
    texts = [None, "", " ", "a", " Ab,cD ", "\x00x\x7fY\x80z", "é\u0130\u212a9{ß`", "\n\nq😀w\u2028e", "--", "x" * 5000 + " Y" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", decontaminate.words(F.col("t")).alias("w"))
    assert {r.i: r.w for r in df.collect()} == {i: words_of(t) for i, t in enumerate(texts)}
    # its matches each copy the whole text
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_short_items_repeats_and_odd_rows(spark, odd):
    w = [f"w{i}" for i in range(40)]
    docs = [
        (20, " ".join(w)), (21, " ".join(w[5:25] * 3)), (22, "a a a a a a a a a a a a a a a a a"), (23, "One, two; three"),
        (24, " ".join(w[:12])), (25, "one two"), (26, "w3 w4 two three one two three one"), (27, None), (28, " ".join(w[3:16] + w[30:40])),
        (None, " ".join(w)), (20, " ".join(w)),
    ]
    items = [(1, " ".join(w[2:34])), (2, "one two three"), (3, "a " * 14), (4, ""), (5, None), (6, "!!"), (None, "one two"), (2, "one two three")]
    docs_df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, t string, s int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.build_index(docs_df, bench)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(index).collect())
    want = []
    for d, t in docs:
        n, h, names = slow(t, items)
        want.append((str(d), n, h, names, h > 0 and 20 * h >= n))
    assert got == sorted(want)
    assert decontaminate.contamination(decontaminate.build_index(odd, bench)).count() == odd.count()
    for a, b in ((odd.limit(0), bench), (odd, bench.limit(0))):
        rows = decontaminate.contamination(decontaminate.build_index(a, b)).collect()
        assert len(rows) == a.count() and not any(r.contaminated for r in rows)


def test_proximity_allows_gaps(spark):
    w = [f"w{i}" for i in range(13)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:6] + ["x", "y"] + w[6:])), (3, " ".join(w[::-1]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    index = decontaminate.build_index(docs, bench, anchors=13)
    near = lambda s: {r.doc_id for r in decontaminate.proximity_matches(index, s).collect()}
    assert near(0) == {1} and near(1) == {1} and near(2) == {1, 2}
    assert {r.doc_id for r in decontaminate.phrase_matches(index).collect()} == {1}


def test_proximity_needs_all_words_of_the_window(spark):
    w = [f"w{i}" for i in range(13)]
    gap = w[:6] + ["x", "y"] + w[6:]
    rows = [(1, w), (2, ["z"] * 20 + gap + ["z"]), (3, [x if x in ("w10", "w12") else "q" for x in w]), (None, w)]
    rows += [(4, [x for x in w if x not in ("w10", "w12")] * 3)]  # makes w10 and w12 the anchors
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in rows], "doc_id long, text string")
    index = decontaminate.build_index(docs, spark.createDataFrame([(1, " ".join(w))], "item_id long, text string"))
    near = lambda s: {r.doc_id for r in decontaminate.proximity_matches(index, s).collect()}
    assert near(0) == near(1) == {1, None} and near(2) == near(3) == {1, 2, None}
