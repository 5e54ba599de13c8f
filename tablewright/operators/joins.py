"""Key joins: merge join (inner / left / right / full / semi), anti join and
its flag form (the as-of join is in ``asof``).

Output contract (fixed here because engines differ):

* every right column is re-aliased before the join, so joining a dataset
  with itself (or with something derived from it) is never ambiguous;
* a right non-key column whose name exists on the left gets ``suffix``; if
  the suffixed name also exists the join is refused;
* ``inner`` / ``left`` / ``semi`` / ``anti``: right keys are dropped;
  ``right``: left keys are dropped, right keys kept under their names;
  ``full``: both key sets kept (right keys suffixed on a name clash).

The physical strategy (broadcast, sort-merge, shuffled hash) is left to
Spark: a side is broadcast only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold``, and AQE re-plans and splits skewed
partitions at run time.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import ident, idents, require_columns, suffixed_names
from ..functions.sizing import maybe_broadcast
from .asof import asof_join  # noqa: F401  part of this module's interface
from .fulljoin import full_outer

JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "semi": "left_semi"}


def _pairs(on) -> tuple[list[str], list[str]]:
    """Key pairs from ``[name, ...]`` or ``[{left, right}, ...]`` (all of one form)."""
    if not on:
        raise ValueError("join needs at least one key")
    if all(isinstance(p, str) for p in on):
        names = idents(on)
        return names, list(names)
    if all(isinstance(p, dict) for p in on):
        for p in on:
            if set(p) != {"left", "right"}:
                raise ValueError(f"join key pair must have exactly 'left' and 'right': {p!r}")
        return [ident(p["left"]) for p in on], [ident(p["right"]) for p in on]
    if all(isinstance(p, (tuple, list)) and len(p) == 2 for p in on):
        return [ident(p[0]) for p in on], [ident(p[1]) for p in on]
    raise ValueError("join keys must be all names or all {left, right} pairs")


def _lower(names) -> set[str]:
    return {n.lower() for n in names}


def merge_join(
    left: DataFrame,
    right: DataFrame,
    on,
    how: str = "inner",
    suffix: str = "_right",
    *,
    null_safe: bool = False,
    broadcast_max_bytes: int | None = None,
    split_full_join: bool | None = None,
) -> DataFrame:
    """Equi-join on key pairs (names may differ between the sides).

    ``broadcast_max_bytes``: hint a broadcast of the right side when the
    optimizer's size estimate is under this bound (inner / left / semi);
    above it, or for right / full joins, Spark's shuffle join is kept.
    A full join spreads rows with null keys over tasks (``fulljoin``);
    ``split_full_join`` says whether it looks for heavy keys to split as well
    (None: where the sides are large by the optimizer's estimate)."""
    if how not in JOIN_TYPES:
        raise ValueError(f"join type must be one of {sorted(JOIN_TYPES)}, not {how!r}")
    lkeys, rkeys = _pairs(on)
    require_columns(left, lkeys, where="left input")
    require_columns(right, rkeys, where="right input")
    # names as the inputs spell them
    lkeys = [{c.lower(): c for c in left.columns}[k.lower()] for k in lkeys]
    rkeys = [{c.lower(): c for c in right.columns}[k.lower()] for k in rkeys]
    kind = JOIN_TYPES[how]
    if kind == "left_semi":
        return semi_join(left, right, on, broadcast_max_bytes=broadcast_max_bytes)
    keep_rk = kind in ("right", "full")
    kept = right.columns if keep_rk else [c for c in right.columns if c.lower() not in _lower(rkeys)]
    names = suffixed_names((left if kind != "right" else left.drop(*lkeys)).columns, kept, suffix)
    tmp = {c: f"_tw_r{i}" for i, c in enumerate(right.columns)}
    r = right.select(*[F.col(c).alias(tmp[c]) for c in right.columns])
    if kind in ("inner", "left"):
        r = maybe_broadcast(r, broadcast_max_bytes)
    eq = (lambda a, b: a.eqNullSafe(b)) if null_safe else (lambda a, b: a == b)
    cond = reduce(and_, [eq(left[lk], r[tmp[rk]]) for lk, rk in zip(lkeys, rkeys)])
    if kind == "full":
        joined = full_outer(left, r, lkeys, [tmp[k] for k in rkeys], null_safe=null_safe, find_heavy=split_full_join)
    else:
        joined = left.join(r, cond, kind)
    lk = _lower(lkeys)
    if kind == "right":
        lcols = [F.col(c) for c in left.columns if c.lower() not in lk]
    else:
        lcols = [F.col(c) if kind == "full" else left[c] for c in left.columns]
    rcols = [F.col(tmp[c]).alias(n) for c, n in names.items()]
    return joined.select(*lcols, *rcols)


def semi_join(left: DataFrame, right: DataFrame, on, *, broadcast_max_bytes: int | None = None) -> DataFrame:
    """Left rows with at least one key match on the right (no duplication)."""
    lkeys, rkeys = _pairs(on)
    require_columns(left, lkeys, where="left input")
    require_columns(right, rkeys, where="right input")
    # only whether a key exists matters: distinct keys are pre-reduced on
    # every map task, so a key repeated on the right ships once per task
    r = maybe_broadcast(right.select(*[F.col(k).alias(f"_tw_k{i}") for i, k in enumerate(rkeys)]).distinct(), broadcast_max_bytes)
    cond = reduce(and_, [left[lk] == r[f"_tw_k{i}"] for i, lk in enumerate(lkeys)])
    return left.join(r, cond, "left_semi")


def anti_join(
    left: DataFrame, right: DataFrame, on, *, flag: str | None = None, overwrite: bool = False, broadcast_max_bytes: int | None = None
) -> DataFrame:
    """Left rows without a key match on the right; rows with a null key never
    match and are kept.  With ``flag`` every left row is kept and the column
    says whether it had no match (true = no match)."""
    lkeys, rkeys = _pairs(on)
    require_columns(left, lkeys, where="left input")
    require_columns(right, rkeys, where="right input")
    # distinct right keys: a key repeated on the right ships once per map task
    r = right.select(*[F.col(k).alias(f"_tw_k{i}") for i, k in enumerate(rkeys)]).distinct()
    cond = reduce(and_, [left[lk] == r[f"_tw_k{i}"] for i, lk in enumerate(lkeys)])
    if not flag:
        return left.join(maybe_broadcast(r, broadcast_max_bytes), cond, "left_anti")
    ident(flag)
    if not overwrite and flag.lower() in _lower(left.columns):
        raise ValueError(f"column {flag!r} already exists; pass overwrite=True to replace it")
    # the keys are distinct, so a key repeated on the right cannot multiply
    # left rows
    marker = maybe_broadcast(r.withColumn("_tw_hit", F.lit(True)), broadcast_max_bytes)
    joined = left.join(marker, cond, "left")
    keep = [left[c] for c in left.columns if c.lower() != flag.lower()]
    return joined.select(*keep, F.col("_tw_hit").isNull().alias(flag))
