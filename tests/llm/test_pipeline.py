import __spark_entry__ as entry
import corpus_pipeline as pipeline
from llm_data import SF_MID
from tablewright.llm import packing, quality_crf, secrets, simhash
from tablewright.llm.common import remainder, table
from test_decontaminate import slow
from test_simhash import classes, slow_fingerprint


def test_run_matches_a_plain_version(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF_MID, "documents").collect()}
    items = [(r.item_id, r.text) for r in table(spark, SF_MID, "benchmark").collect()]
    labels = table(spark, SF_MID, "labels").where(remainder("doc_id", 5) != 0)
    model = quality_crf.fit_sample(table(spark, SF_MID, "documents"), labels)
    kept = {d: t for d, t in docs.items() if model.quality(t) >= 0.3}
    assert len(kept) < len(docs)
    fps = {d: slow_fingerprint(t) for d, t in kept.items()}
    label, least = classes(fps.values(), 4), {}
    for d, f in fps.items():
        least[label[f]] = min(d, least.get(label[f], d))
    kept = {d: kept[d] for d in least.values()}
    for d in list(kept):
        n, h, _ = slow(kept[d], items)
        if h and 20 * h >= n:
            del kept[d]
    encoding = secrets._encoding(packing.vocabulary_path(secrets.VOCABULARY))
    ids = packing.WordIds(packing.vocabulary_path())
    want = {}
    for d, t in kept.items():
        clean = secrets.replace_spans(t, secrets.spans(t, encoding), "[secret]")
        want[d] = ids.encode(clean) + (1).to_bytes(4, "little")
    got = {}
    for r in sorted(pipeline.run(spark, SF_MID).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] = got.get(r.doc_id, b"") + r.ids
    assert got == want


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd):
    extra = odd.selectExpr("*", "1 AS row", "2 AS _row", "3 AS component_id", "4 AS score")
    for name, step in pipeline.STAGES[:-1]:
        out = step(spark, extra, SF_MID)
        assert out.columns == extra.columns and out.dtypes == extra.dtypes, name
        out.collect()
        assert step(spark, extra.limit(0), SF_MID).count() == 0
    kept = pipeline.near_dup(spark, extra, SF_MID)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6, 8, 9]
    assert pipeline.STAGES[-1][1](spark, extra.limit(0), SF_MID).count() == 0


def test_registered(spark):
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {"op1", "op2", "op3", "op6", "op10"}
    assert simhash.RADIUS == 4
