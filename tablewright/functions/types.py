"""Type names, strict/lenient casts, date formats and canonical text.

Everything here returns Spark ``Column`` expressions; nothing runs per row
in Python.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names accepted in configs and the Spark type each maps to.
# ``decimal`` is exact here; a ``decimal(p,s)`` spelling is accepted as well.
TYPE_NAMES = {
    "string": "string",
    "int": "bigint",
    "integer": "bigint",
    "float": "double",
    "double": "double",
    "decimal": "decimal(38,18)",
    "bool": "boolean",
    "boolean": "boolean",
    "date": "date",
    "datetime": "timestamp_ntz",
    "timestamp": "timestamp_ntz",
}

# The stricter set used by target column mapping casts.
MAPPING_TYPE_NAMES = ("string", "integer", "float", "boolean", "date", "datetime")


def spark_type(name: str) -> str:
    """Spark SQL type string for a config type name."""
    key = name.strip().lower()
    if key in TYPE_NAMES:
        return TYPE_NAMES[key]
    if key.startswith("decimal(") and key.endswith(")"):
        p, _, s = key[8:-1].partition(",")
        if p.strip().isdigit() and s.strip().isdigit():
            return f"decimal({int(p)},{int(s)})"
    raise ValueError(f"Unsupported type: {name!r}")


# Strftime codes and the Spark datetime pattern for each.
STRFTIME_TO_SPARK = {
    "%Y": "yyyy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%y": "yy",
    "%b": "MMM",
    "%B": "MMMM",
    "%j": "DDD",
    "%p": "a",
    "%I": "hh",
    "%z": "xx",
    "%%": "%",
}


def spark_pattern(fmt: str) -> str:
    """Translate a strftime format to a Spark datetime pattern.

    Letters outside a ``%`` code are quoted so Spark reads them literally;
    an unknown ``%`` code is refused.
    """
    out: list[str] = []
    literal: list[str] = []

    def flush() -> None:
        if literal:
            text = "".join(literal).replace("'", "''")
            out.append(f"'{text}'" if any(ch.isalpha() for ch in text) or "'" in text else text)
            literal.clear()

    i = 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%":
            code = fmt[i : i + 2]
            if code not in STRFTIME_TO_SPARK:
                raise ValueError(f"Unsupported format code {code!r} in {fmt!r}")
            flush()
            out.append(STRFTIME_TO_SPARK[code])
            i += 2
            continue
        literal.append(ch)
        i += 1
    flush()
    return "".join(out)


def convert(col: Column, type_name: str, fmt: str | None = None, strict: bool = True) -> Column:
    """Cast or parse ``col`` to the named type.

    strict -> ``cast`` / ``to_date`` / ``to_timestamp_ntz`` (ANSI mode raises on
    bad input); lenient -> ``try_cast`` / ``try_to_date`` style (null on bad input).
    """
    target = spark_type(type_name)
    if fmt and target in ("date", "timestamp_ntz"):
        pattern = F.lit(spark_pattern(fmt))
        text = col.cast("string")
        if target == "date":
            return F.to_date(text, spark_pattern(fmt)) if strict else F.try_to_date(text, spark_pattern(fmt))
        if strict:
            return F.to_timestamp_ntz(text, pattern)
        # parse as zone-less directly (a session-zone round trip would move
        # wall times that fall into a daylight-saving gap); the strict parser
        # only runs where the lenient one succeeded, so it cannot raise
        return F.when(F.try_to_timestamp(text, pattern).isNotNull(), F.to_timestamp_ntz(text, pattern))
    if fmt:
        raise ValueError(f"a format applies to date/datetime only, not {type_name!r}")
    return col.cast(target) if strict else col.try_cast(target)


def canon(col: Column, dtype: T.DataType) -> Column:
    """Canonical text of a value, identical across runs and engines.

    integers / strings / booleans / dates / decimals: plain cast;
    floats: the shortest text that reads back as the same value, so two
    different values never share a text;
    timestamps: ``yyyy-MM-dd HH:mm:ss.SSSSSS``.
    """
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    return col.cast("string")
