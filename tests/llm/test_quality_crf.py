import itertools
import zlib

import numpy as np

from llm_data import SF_MID
from tablewright.llm import quality_crf as crf
from tablewright.llm import queries


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    t, chains = rng.normal(size=(2, 2)), [rng.normal(size=n) for n in (1, 4, 3)]
    got, pairs, log_z = crf.chain_marginals(chains, t)
    want_pairs, want_z = np.zeros((2, 2)), 0.0
    for e, p in zip(chains, got):
        paths = list(itertools.product((0, 1), repeat=len(e)))
        weight = np.exp([sum(y * s for y, s in zip(p, e)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in paths])
        want_z += np.log(weight.sum())
        weight /= weight.sum()
        assert np.allclose(p, [sum(w for w, y in zip(weight, paths) if y[i]) for i in range(len(e))])
        for w, y in zip(weight, paths):
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w
    assert np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_neighbours_change_a_line():
    bad, good = "x%% y$$ z&& q## %% $$ ## &&", "A plain line of some ordinary words, read by people."
    chains = [crf.line_features("\n".join([bad] * 6))[0]] * 20 + [crf.line_features("\n".join([good] * 6))[0]] * 20
    model = crf.fit(chains, [0] * 20 + [1] * 20)
    odd_line = lambda around: model.marginals(crf.line_features("\n".join([around] * 3 + ["So."] + [around] * 3))[0])[3]
    assert odd_line(good) > odd_line(bad)


def test_held_out_accuracy(spark):
    rows = queries.op10_quality(spark, SF_MID).toPandas()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.itertuples())
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").toPandas()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert len(both) > 50 and (both.predicted == both.quality).mean() >= 0.97


def test_odd_rows_and_missing_labels(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (99, 0), (None, 1)], "doc_id long, quality int")
    model = crf.fit_sample(odd, labels)
    scores = crf.classify(odd, model).collect()
    assert len(scores) == odd.count() and all(r.score == 0.5 for r in scores)  # one kind only
    model = crf.fit_sample(odd, spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in crf.classify(odd, model).collect())
    assert crf.classify(odd.limit(0), model).count() == 0
    assert crf.fit_sample(odd.limit(0), labels).bias == 0
