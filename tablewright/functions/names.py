"""Identifier rules shared by every step.

Names are checked while the plan is built so a bad config fails before any
data is read.  Spark resolves column names case-insensitively by default, so
two names that differ only by case are refused as well.
"""
from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def ident(name: str) -> str:
    """Return ``name`` if it is a plain identifier, else raise ``ValueError``."""
    if not isinstance(name, str) or not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"Invalid identifier: {name!r}")
    return name


def idents(names: Iterable[str], *, what: str = "columns", allow_empty: bool = False) -> list[str]:
    out = [ident(n) for n in names]
    if not out and not allow_empty:
        raise ValueError(f"{what} must not be empty")
    return out


def require_columns(df: DataFrame, names: Iterable[str], *, where: str = "input") -> None:
    """Raise ``ValueError`` naming every column of ``names`` absent from ``df``."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"{where} is missing columns: {missing}")


def check_case_collisions(df: DataFrame, *, where: str = "input") -> None:
    seen: dict[str, str] = {}
    for c in df.columns:
        k = c.lower()
        if k in seen and seen[k] != c:
            raise ValueError(f"{where} has columns differing only by case: {seen[k]!r}, {c!r}")
        seen[k] = c


def field_type(df: DataFrame, name: str):
    """Spark data type of column ``name`` (case-insensitive)."""
    for f in df.schema.fields:
        if f.name.lower() == name.lower():
            return f.dataType
    raise ValueError(f"unknown column {name!r}")


def suffixed_names(taken: Iterable[str], names: Iterable[str], suffix: str) -> dict[str, str]:
    """Output name for each of ``names`` beside the columns ``taken``: its own,
    or with ``suffix`` where that is taken."""
    used = {c.lower() for c in taken}
    out: dict[str, str] = {}
    for c in names:
        name = c if c.lower() not in used else c + suffix
        if name.lower() in used:
            raise ValueError(f"column {c!r} clashes after suffix {suffix!r}")
        used.add(name.lower())
        out[c] = name
    return out
