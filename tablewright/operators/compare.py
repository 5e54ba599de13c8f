"""Dataset comparison: reconciliation, delta detection, snapshot difference
and cross-dataset rules, all on one kernel.

Kernel: mark each side, full outer join on equal key names (keys come out
once, coalesced), suffix clashing right columns, then a ``when`` chain
writes a status.  A value differs when exactly one side is null, or both
are set and differ (beyond ``tolerance`` for numeric columns; text always
compares exactly).  Null keys never match, so a null-key row appears once
from each side.

The join is one full outer join (``fulljoin``): two exchanges, one pass over
each side, rows with null keys dealt over the tasks.  Heavy keys are looked
for and split where the sides are large, or where ``split_full_join`` asks.

``only_changes=True`` returns no rows of the last status.  Digests by range of
keys find where the sides differ (``digests``), in jobs of their own, and only
rows of those ranges are joined.  Keys are taken to be unique: rows repeated
alike on both sides count as equal, duplicates are looked for in the ranges
that differ.

``on_duplicate_keys="error"`` runs one aggregate job for each side while the
plan is built.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import field_type, ident, idents, require_columns
from .digests import differing
from .fulljoin import full_outer


def value_differs(left: Column, right: Column, tolerance: float | None, numeric: bool) -> Column:
    """True where the pair differs; both null -> equal; one null -> differs."""
    if tolerance and numeric:
        one_null = left.isNull() != right.isNull()
        # equal values (NaN = NaN included) never differ; Spark orders NaN
        # above every number, so abs(NaN - NaN) > tol alone would say they do
        far = F.coalesce(F.abs(left - right) > F.lit(float(tolerance)), F.lit(False))
        return one_null | (far & ~left.eqNullSafe(right))
    return ~left.eqNullSafe(right)


DUPLICATE_KEY_RULES = ("allow", "error")


def check_unique_keys(df: DataFrame, keys: Sequence[str], where: str) -> None:
    """Raise if any key occurs twice: one aggregate pass (partial counts per
    map task first, so a hot key is pre-reduced), one row to the driver."""
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"{where} has duplicate keys, e.g. {dict(dup[0].asDict())}")


def _spelled(df: DataFrame, name: str) -> str:
    return next(c for c in df.columns if c.lower() == name.lower())


def _kernel(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    compare_columns: Sequence[str] | None,
    tolerance: float | None,
    suffix: str,
    labels: tuple[str, str, str, str],
    status_column: str,
    on_duplicate_keys: str = "allow",
    columns: str = "all",
    split_full_join: bool | None = None,
    only_changes: bool = False,
) -> DataFrame:
    ks = idents(keys, what="keys")
    cmp = idents(compare_columns or [], allow_empty=True)
    require_columns(a, ks + cmp, where="first input")
    require_columns(b, ks + cmp, where="second input")
    if columns not in ("all", "compared"):
        raise ValueError("columns must be 'all' or 'compared'")
    both = {k.lower() for k in ks} & {c.lower() for c in cmp}
    if both:
        raise ValueError(f"keys cannot be compare columns: {sorted(both)}")
    if columns == "compared":
        # only keys and compared values cross the shuffle
        a, b = a.select(*ks, *cmp), b.select(*ks, *cmp)
    if on_duplicate_keys not in DUPLICATE_KEY_RULES:
        raise ValueError(f"on_duplicate_keys must be one of {DUPLICATE_KEY_RULES}")
    if only_changes:
        a, b = differing(a, b, [_spelled(a, k) for k in ks], [_spelled(a, c) for c in cmp])
    if on_duplicate_keys == "error":
        # duplicated keys multiply rows in the join; refuse them up front
        check_unique_keys(a, ks, "first input")
        check_unique_keys(b, ks, "second input")
    ident(status_column)
    kl = {k.lower() for k in ks}
    a_cols = [c for c in a.columns if c.lower() not in kl]
    taken = {c.lower() for c in a.columns}
    b_names: dict[str, str] = {}
    for c in b.columns:
        if c.lower() in kl:
            continue
        name = c + suffix if c.lower() in taken else c
        if name.lower() in taken:
            raise ValueError(f"column {c!r} clashes after suffix {suffix!r}")
        taken.add(name.lower())
        b_names[c] = name
    if status_column.lower() in taken or status_column.lower() in kl:
        raise ValueError(f"status column {status_column!r} clashes with an input column")
    bk = {k: f"_tw_k{i}" for i, k in enumerate(ks)}
    bb = b.select(
        *[F.col(k).alias(bk[k]) for k in ks],
        *[F.col(c).alias(n) for c, n in b_names.items()],
        F.lit(True).alias("_tw_in_b"),
    )
    aa = a.withColumn("_tw_in_a", F.lit(True))
    j = full_outer(aa, bb, [_spelled(aa, k) for k in ks], [bk[k] for k in ks], find_heavy=split_full_join)

    def right_of(c: str) -> str:
        return next(n for src, n in b_names.items() if src.lower() == c.lower())

    diffs = []
    for c in cmp:
        numeric = isinstance(field_type(a, c), T.NumericType) and isinstance(field_type(b, c), T.NumericType)
        diffs.append(value_differs(F.col(c), F.col(right_of(c)), tolerance, numeric))
    any_diff = reduce(or_, diffs) if diffs else F.lit(False)
    only_a, only_b, changed, same = labels
    status = (
        F.when(F.col("_tw_in_b").isNull(), F.lit(only_a))
        .when(F.col("_tw_in_a").isNull(), F.lit(only_b))
        .when(any_diff, F.lit(changed))
        .otherwise(F.lit(same))
    )
    if only_changes:
        j = j.where(status != F.lit(same))
    return j.select(
        *[F.coalesce(F.col(k), F.col(bk[k])).alias(k) for k in ks],
        *[F.col(c) for c in a_cols],
        *[F.col(n) for n in b_names.values()],
        status.alias(status_column),
    )


# Status labels of each comparison, in test order
# (only in first input, only in second, values differ, equal).
RECON_LABELS = ("MISSING_IN_TARGET", "MISSING_IN_SOURCE", "MISMATCHED", "MATCHED")
DELTA_LABELS = ("DELETE", "INSERT", "UPDATE", "UNCHANGED")
SNAPSHOT_LABELS = ("REMOVED", "ADDED", "CHANGED", "UNCHANGED")


def reconcile(
    src, tgt, keys, compare_columns=None, tolerance=None, *, status_column="recon_status", on_duplicate_keys="allow", columns="all",
    split_full_join=None, only_changes=False,
):
    return _kernel(src, tgt, keys, compare_columns, tolerance, "_tgt", RECON_LABELS, status_column, on_duplicate_keys, columns, split_full_join, only_changes)


def delta(
    old, new, keys, compare_columns=None, tolerance=None, *, status_column="change_type", on_duplicate_keys="allow", columns="all",
    split_full_join=None, only_changes=False,
):
    return _kernel(old, new, keys, compare_columns, tolerance, "_new", DELTA_LABELS, status_column, on_duplicate_keys, columns, split_full_join, only_changes)


def snapshot_diff(
    d1, d2, keys, compare_columns=None, tolerance=None, *, status_column="change_status", on_duplicate_keys="allow", columns="all",
    split_full_join=None, only_changes=False,
):
    return _kernel(d1, d2, keys, compare_columns, tolerance, "_d2", SNAPSHOT_LABELS, status_column, on_duplicate_keys, columns, split_full_join, only_changes)


RULE_OPS = ("eq", "neq", "gt", "gte", "lt", "lte")


def _rule(left: Column, right: Column, op: str, tolerance: float) -> Column:
    """``tolerance`` counts for numbers only (the caller passes 0 for others)."""
    if op == "eq":
        return F.abs(left - right) <= F.lit(tolerance) if tolerance else left == right
    if op == "neq":
        return F.abs(left - right) > F.lit(tolerance) if tolerance else left != right
    return {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]


def cross_validate(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    rules: Sequence[dict],
    *,
    status_column: str = "validation_status",
    on_duplicate_keys: str = "allow",
) -> DataFrame:
    """Inner join on keys (right clashes get ``_right``); PASS when every rule
    holds, FAIL otherwise (a null rule result is a FAIL).  A rule names the
    right column by its post-join name."""
    ks = idents(keys, what="keys")
    if not rules:
        raise ValueError("cross-validate needs at least one rule")
    require_columns(left, ks, where="left input")
    require_columns(right, ks, where="right input")
    if on_duplicate_keys not in DUPLICATE_KEY_RULES:
        raise ValueError(f"on_duplicate_keys must be one of {DUPLICATE_KEY_RULES}")
    if on_duplicate_keys == "error":
        check_unique_keys(left, ks, "left input")
        check_unique_keys(right, ks, "right input")
    ident(status_column)
    kl = {k.lower() for k in ks}
    taken = {c.lower() for c in left.columns}
    r_names: dict[str, str] = {}
    for c in right.columns:
        if c.lower() in kl:
            continue
        name = c + "_right" if c.lower() in taken else c
        if name.lower() in taken:
            raise ValueError(f"column {c!r} clashes after suffix '_right'")
        taken.add(name.lower())
        r_names[c] = name
    rk = {k: f"_tw_k{i}" for i, k in enumerate(ks)}
    rr = right.select(*[F.col(k).alias(rk[k]) for k in ks], *[F.col(c).alias(n) for c, n in r_names.items()])
    j = left.join(rr, reduce(and_, [left[k] == rr[rk[k]] for k in ks]), "inner")
    out_cols = [left[c] for c in left.columns] + [F.col(n) for n in r_names.values()]
    j = j.select(*out_cols)
    checks = []
    for rule in rules:
        extra = set(rule) - {"left_column", "right_column", "op", "tolerance"}
        if extra:
            raise ValueError(f"unknown rule fields: {sorted(extra)}")
        lc, rc = ident(rule["left_column"]), ident(rule["right_column"])
        require_columns(j, [lc, rc], where="joined input")
        op = rule.get("op", "eq")
        if op not in RULE_OPS:
            raise ValueError(f"rule op must be one of {RULE_OPS}, not {op!r}")
        numbers = all(isinstance(field_type(j, c), T.NumericType) for c in (lc, rc))
        checks.append(_rule(F.col(lc), F.col(rc), op, float(rule.get("tolerance") or 0.0) if numbers else 0.0))
    ok = reduce(and_, checks)
    return j.withColumn(status_column, F.when(F.coalesce(ok, F.lit(False)), F.lit("PASS")).otherwise(F.lit("FAIL")))
