"""Union of several inputs, by column name.

``union_all`` requires equal column names and types (plain positional
``union`` would silently widen or re-type); ``align_schema`` fills columns
absent from an input with nulls but still refuses a shared name with two
different types.  ``union`` adds a ``distinct`` (nulls compare equal).
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

UNION_TYPES = ("union_all", "union")


def _types(df: DataFrame) -> dict[str, tuple[str, object]]:
    return {f.name.lower(): (f.name, f.dataType) for f in df.schema.fields}


def check_union_schemas(frames: Sequence[DataFrame], align_schema: bool) -> None:
    first = _types(frames[0])
    merged = dict(first)
    for i, df in enumerate(frames[1:], start=1):
        cur = _types(df)
        if not align_schema and set(cur) != set(first):
            raise ValueError(
                f"union input {i} has columns {sorted(n for n, _ in cur.values())}, "
                f"input 0 has {sorted(n for n, _ in first.values())}; use align_schema=True"
            )
        for key, (name, dt) in cur.items():
            if key in merged and merged[key][1] != dt:
                raise ValueError(
                    f"union column {name!r} is {dt.simpleString()} in input {i} "
                    f"but {merged[key][1].simpleString()} earlier"
                )
            merged.setdefault(key, (name, dt))


def union(frames: Sequence[DataFrame], union_type: str = "union_all", *, align_schema: bool = False) -> DataFrame:
    if union_type not in UNION_TYPES:
        raise ValueError(f"union type must be one of {UNION_TYPES}, not {union_type!r}")
    if len(frames) < 2:
        raise ValueError("union needs at least two inputs")
    check_union_schemas(frames, align_schema)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=align_schema), frames)
    return out.distinct() if union_type == "union" else out
