"""Property tests: operators against plain-Python models on random small
tables with nulls, NaN and repeated keys."""
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablewright.operators import compare, joins, rows

SETTINGS = settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

keys = st.one_of(st.none(), st.integers(0, 6))
vals = st.one_of(st.none(), st.sampled_from([0.0, 1.0, 1.25, 2.0, float("nan")]))
table = st.lists(st.tuples(keys, vals), max_size=12)


def _differs(a, b, tol):
    if a is None and b is None:
        return False
    if (a is None) != (b is None):
        return True
    if math.isnan(a) and math.isnan(b):
        return False
    if math.isnan(a) or math.isnan(b):
        return True
    return abs(a - b) > tol if tol else a != b


def _recon_model(src, tgt, tol):
    out = []
    for k, v in src:
        matches = [w for k2, w in tgt if k is not None and k2 == k]
        if not matches:
            out.append((k, "MISSING_IN_TARGET"))
        for w in matches:
            out.append((k, "MISMATCHED" if _differs(v, w, tol) else "MATCHED"))
    for k2, w in tgt:
        if k2 is None or not any(k == k2 for k, _ in src):
            out.append((k2, "MISSING_IN_SOURCE"))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


@SETTINGS
@given(src=table, tgt=table, tol=st.sampled_from([None, 0.5]))
def test_reconcile_matches_model(spark, src, tgt, tol):
    a = spark.createDataFrame(src, "k bigint, v double")
    b = spark.createDataFrame(tgt, "k bigint, v double")
    got = sorted(((r.k, r.recon_status) for r in compare.reconcile(a, b, ["k"], ["v"], tol).collect()),
                 key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert got == _recon_model(src, tgt, tol)


@SETTINGS
@given(left=table, right=table)
def test_anti_and_semi_partition_left(spark, left, right):
    a = spark.createDataFrame(left, "k bigint, v double")
    b = spark.createDataFrame(right, "k bigint, v double")
    right_keys = {k for k, _ in right if k is not None}
    anti = joins.anti_join(a, b, ["k"]).count()
    semi = joins.semi_join(a, b, ["k"]).count()
    assert anti == sum(1 for k, _ in left if k is None or k not in right_keys)
    assert anti + semi == len(left)
    flags = [r.miss for r in joins.anti_join(a, b, ["k"], flag="miss").collect()]
    assert sorted(flags) == sorted(k is None or k not in right_keys for k, _ in left)


@SETTINGS
@given(data=st.lists(st.tuples(st.integers(0, 4), st.integers(0, 50), st.integers(0, 3)), max_size=15))
def test_dedup_matches_model(spark, data):
    df = spark.createDataFrame(data, "k bigint, t bigint, v bigint")
    first = sorted(tuple(r) for r in rows.deduplicate(df, ["k"], "first", order_by=["t"]).collect())
    want = {}
    for k, t, v in sorted(data, key=lambda x: (x[1], x[2])):
        want.setdefault(k, (k, t, v))
    assert first == sorted(want.values())
    counts = {}
    for k, _, _ in data:
        counts[k] = counts.get(k, 0) + 1
    none = sorted(tuple(r) for r in rows.deduplicate(df, ["k"], "none").collect())
    assert none == sorted(x for x in data if counts[x[0]] == 1)


@SETTINGS
@given(left=table, right=table, null_safe=st.booleans())
def test_full_join_matches_model(spark, left, right, null_safe):
    a = spark.createDataFrame(left, "k bigint, v double")
    b = spark.createDataFrame(right, "k bigint, v double")

    def same(x, y):
        return x == y if (x is not None and y is not None) else (null_safe and x is None and y is None)

    want = []
    for k, v in left:
        partners = [(k2, w) for k2, w in right if same(k, k2)]
        want += [(k, v, k2, w) for k2, w in partners] or [(k, v, None, None)]
    for k2, w in right:
        if not any(same(k, k2) for k, _ in left):
            want.append((None, None, k2, w))
    got = [tuple(r) for r in joins.merge_join(a, b, ["k"], "full", null_safe=null_safe).collect()]

    def key(t):
        return tuple((x is None, 0 if x is None else (1e9 if x != x else x)) for x in t)

    assert sorted(map(_canon_row, got), key=key) == sorted(map(_canon_row, want), key=key)


def _canon_row(t):
    return tuple(float("inf") if isinstance(x, float) and math.isnan(x) else x for x in t)
