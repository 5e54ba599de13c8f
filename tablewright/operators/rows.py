"""Single-input row steps: filter/flag, sort, limit, sample, de-duplicate,
row hash and format conversion.

Every function takes a DataFrame and returns a new lazy DataFrame; nothing
is collected.  Order-dependent steps (``first``/``last`` de-duplication)
take an explicit ``order_by`` because a distributed frame has no input order.
"""
from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import row_hash_column
from ..functions.names import ident, idents, require_columns
from ..functions.predicates import condition
from ..functions.types import canon, convert
from ..sources.sinks import write_staging

# ---------------------------------------------------------------- helpers


def _check_new_column(df: DataFrame, name: str, overwrite: bool) -> str:
    ident(name)
    if not overwrite and name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {name!r} already exists; pass overwrite=True to replace it")
    return name


def order_columns(order_by: Sequence[str | Column] | None, descending: bool = False) -> list[Column]:
    out: list[Column] = []
    for o in order_by or []:
        c = F.col(ident(o)) if isinstance(o, str) else o
        out.append(c.desc_nulls_last() if descending else c.asc_nulls_first())
    return out


# ---------------------------------------------------------------- filter


def filter_rows(df: DataFrame, cond: dict | Column, *, flag: str | None = None, overwrite: bool = False) -> DataFrame:
    """Keep rows where the condition is true; with ``flag`` keep every row and
    write the condition (true / false / null) to that column instead."""
    c = condition(cond, df) if isinstance(cond, dict) else cond
    if flag:
        return df.withColumn(_check_new_column(df, flag, overwrite), c)
    return df.filter(c)


# ---------------------------------------------------------------- sort / limit


def sort_rows(df: DataFrame, columns: Sequence[str], order: str = "asc", nulls_last: bool = True) -> DataFrame:
    cols = idents(columns)
    require_columns(df, cols)
    if order not in ("asc", "desc"):
        raise ValueError(f"order must be 'asc' or 'desc', not {order!r}")
    key = {
        ("asc", True): lambda c: F.col(c).asc_nulls_last(),
        ("asc", False): lambda c: F.col(c).asc_nulls_first(),
        ("desc", True): lambda c: F.col(c).desc_nulls_last(),
        ("desc", False): lambda c: F.col(c).desc_nulls_first(),
    }[(order, bool(nulls_last))]
    return df.orderBy(*[key(c) for c in cols])


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows: after a sort the top rows in its order, otherwise
    no particular ones.  Always Spark's limit, for any ``n``."""
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError("limit must be a positive integer")
    return df.limit(n)


# ---------------------------------------------------------------- sample


def sample_rows(
    df: DataFrame,
    fraction: float,
    seed: int | None = None,
    *,
    exact: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Random sample without replacement.

    ``exact=False``: Bernoulli sample (one pass, no shuffle, size close to
    ``n * fraction``): a row stays if the first 32 bits of its SHA-256 over
    ``columns`` (default: all) and the seed are below the fraction, so the
    choice does not depend on partitioning and equal rows stay or go together.  ``exact=True``: exactly ``floor(n * fraction)`` rows, the
    ones with the smallest SHA-256 of ``columns`` (default: all) and the seed.
    """
    if not (0 < float(fraction) <= 1):
        raise ValueError("sample_fraction must be in (0, 1]")
    cols = idents(columns) if columns else list(df.columns)
    if not exact:
        cut = int(float(fraction) * (1 << 32))
        if cut >= 1 << 32:
            return df
        chosen = random.getrandbits(63) if seed is None else int(seed)
        return df.filter(F.substring(seeded_hash(df, cols, chosen), 1, 8) < F.lit(f"{cut:08x}"))
    frac = float(fraction)
    return _hash_select(df, cols, 0 if seed is None else int(seed), lambda total: int(total * frac))


def seeded_hash(df: DataFrame, columns: Sequence[str], seed: int) -> Column:
    parts = [F.coalesce(canon(F.col(c), df.schema[c].dataType), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts, F.lit(str(seed))), 256)


def _cut(counts: dict[str, int], need: int) -> tuple[str, int, int]:
    """The value at which sorted counts reach ``need``, the rows needed of it,
    and its rows."""
    for value in sorted(counts):
        if need <= counts[value]:
            return value, need, counts[value]
        need -= counts[value]
    raise ValueError("fewer rows than asked for")


def _copies(equal: DataFrame, need: int) -> DataFrame:
    """``need`` of rows that are all equal.  Every task that reads some of them
    gets a quota of at most as many, from a staged table of one row for each
    task; no task makes more copies than it has read."""
    share = F.spark_partition_id()
    shares = equal.select(share.alias("_tw_share"), F.struct(*[F.col(c) for c in equal.columns]).alias("_tw_row"))
    shares = write_staging(shares.groupBy("_tw_share").agg(F.count("*").alias("_tw_n"), F.first("_tw_row").alias("_tw_row")))
    upto = F.sum("_tw_n").over(Window.orderBy("_tw_share"))
    quota = F.least(F.col("_tw_n"), F.lit(need) - (upto - F.col("_tw_n")))
    quotas = shares.withColumn("_tw_quota", quota).where("_tw_quota > 0").repartition(max(1, shares.count()), "_tw_share")
    return quotas.select("_tw_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_tw_quota")))).select("_tw_row.*")


def _hash_select(df: DataFrame, cols: Sequence[str], seed: int, share) -> DataFrame:
    """The ``share(total)`` rows with the smallest seeded hash of ``cols``.

    The last hash taken is found by three aggregates over the hashed columns:
    counts by the first 16 bits (at most 65,536 rows to the driver), by the
    next 16 bits within the bucket of the cut, and by whole hashes within that
    (the rows' 2^32nd part).  The returned plan is one scan with a filter.  Rows
    that share the last hash are told apart by a hash of the whole row; of rows
    that are equal altogether each task that reads some makes its quota.
    """
    h = seeded_hash(df, cols, seed)

    def count(part: Column, rows: DataFrame) -> dict[str, int]:
        return {r.v: r.n for r in rows.groupBy(part.alias("v")).agg(F.count("*").alias("n")).collect()}

    first = count(F.substring(h, 1, 4), df)
    need = share(sum(first.values()))
    if need <= 0:
        return df.limit(0)
    a, need, _ = _cut(first, need)
    b, need, _ = _cut(count(F.substring(h, 5, 4), df.filter(h.startswith(a))), need)
    last, need, tied = _cut(count(h, df.filter(h.startswith(a + b))), need)
    if need == tied:
        return df.filter(h <= last)
    ties = df.filter(h == last)
    if {c.lower() for c in cols} == {c.lower() for c in df.columns}:
        some = _copies(ties, need)
    else:
        some = _hash_select(ties, list(df.columns), seed, lambda total: need)
    return df.filter(h < last).unionByName(some)


# ---------------------------------------------------------------- de-duplicate

DEDUP_KEEP = ("first", "last", "any", "none")


def deduplicate(
    df: DataFrame,
    subset: Sequence[str],
    keep: str = "first",
    order_by: Sequence[str | Column] | None = None,
) -> DataFrame:
    """One row per ``subset`` key.

    first / last: the row that sorts first / last by ``order_by`` (remaining
    columns break ties), via ``row_number() = 1``, which Spark plans with a
    partial per-partition limit before the shuffle, so a hot key does not
    reach the reducer whole.  any: an arbitrary row (``dropDuplicates``).
    none: drop every row whose key occurs more than once.
    """
    keys = idents(subset, what="subset")
    require_columns(df, keys)
    if keep not in DEDUP_KEEP:
        raise ValueError(f"keep must be one of {DEDUP_KEEP}, not {keep!r}")
    cols = df.columns
    if keep == "any":
        return df.dropDuplicates(keys)
    others = [c for c in cols if c.lower() not in {k.lower() for k in keys}]
    if keep == "none":
        if not others:
            return df.groupBy(*keys).count().filter(F.col("count") == 1).select(*keys)
        agg = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_tw_n"),
            F.min(F.struct(*[F.col(c) for c in others])).alias("_tw_row"),
        )
        return agg.filter(F.col("_tw_n") == 1).select(*keys, "_tw_row.*").select(*cols)
    if not order_by:
        raise ValueError(f"keep={keep!r} needs order_by: a distributed dataset has no input order")
    named = [o for o in order_by if isinstance(o, str)]
    require_columns(df, named)
    ties = [c for c in others if c.lower() not in {n.lower() for n in named}]
    desc = keep == "last"
    w = Window.partitionBy(*keys).orderBy(*order_columns(list(order_by) + ties, descending=desc))
    return df.withColumn("_tw_rn", F.row_number().over(w)).filter(F.col("_tw_rn") == 1).drop("_tw_rn")


# ---------------------------------------------------------------- row hash


def row_hash(
    df: DataFrame, columns: Sequence[str], target_column: str = "row_hash", algo: str = "sha256", *, overwrite: bool = True
) -> DataFrame:
    cols = idents(columns)
    require_columns(df, cols)
    return df.withColumn(_check_new_column(df, target_column, overwrite), row_hash_column(df, cols, algo))


# ---------------------------------------------------------------- format conversion


def format_convert(df: DataFrame, columns: Sequence[dict], *, flag: str | None = None, overwrite: bool = False) -> DataFrame:
    """Convert columns in place: ``[{name, type, format?, strict=True}]``.

    With ``flag`` exactly one entry is allowed and the converted value goes to
    that new column, leaving the original untouched.
    """
    if not columns:
        raise ValueError("format-convert needs at least one column entry")
    specs = []
    for spec in columns:
        extra = set(spec) - {"name", "type", "format", "strict"}
        if extra:
            raise ValueError(f"unknown format-convert fields: {sorted(extra)}")
        name = ident(spec["name"])
        require_columns(df, [name])
        specs.append((name, convert(F.col(name), spec["type"], spec.get("format"), spec.get("strict", True))))
    if flag:
        if len(specs) != 1:
            raise ValueError("flag_column on format-convert requires exactly one entry in columns")
        return df.withColumn(_check_new_column(df, flag, overwrite), specs[0][1])
    return df.withColumns(dict(specs))
