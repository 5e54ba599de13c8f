"""Row fingerprint: SHA-256 of the canonical text of chosen columns.

Each column is turned into canonical text (null -> empty string), the parts
are joined with ``|`` and hashed with the native ``sha2``; it stays inside
whole-stage codegen, no Python runs per row.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import field_type, idents
from .types import canon

# Separator and the only supported algorithm.
SEPARATOR = "|"
ALGORITHMS = ("sha256",)


def row_hash_column(df: DataFrame, columns: Sequence[str], algo: str = "sha256") -> Column:
    if algo not in ALGORITHMS:
        raise ValueError(f"row hash algorithm must be one of {ALGORITHMS}, not {algo!r}")
    cols = idents(columns)
    parts = [F.coalesce(canon(F.col(c), field_type(df, c)), F.lit("")) for c in cols]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)
