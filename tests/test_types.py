"""Type names, strftime translation and canonical text."""
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.types import canon, convert, spark_pattern, spark_type


def test_spark_pattern():
    assert spark_pattern("%Y-%m-%d %H:%M:%S") == "yyyy-MM-dd HH:mm:ss"
    assert spark_pattern("%Y-%m-%dT%H:%M:%S.%f") == "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    assert spark_pattern("%d/%m/%y %I%p") == "dd/MM/yy hha"
    assert spark_pattern("day %j of %Y") == "'day 'DDD' of 'yyyy"
    with pytest.raises(ValueError, match="Unsupported format code"):
        spark_pattern("%Q")


def test_spark_type_names():
    assert spark_type("int") == spark_type("integer") == "bigint"
    assert spark_type("decimal") == "decimal(38,18)" and spark_type("Decimal(10, 2)") == "decimal(10,2)"
    assert spark_type("timestamp") == spark_type("datetime") == "timestamp_ntz"
    with pytest.raises(ValueError):
        spark_type("uuid")


def test_parse_with_literal_text(spark):
    df = spark.createDataFrame([("2024-05-06T07:08:09.123456",)], "s string")
    out = df.select(convert(F.col("s"), "datetime", "%Y-%m-%dT%H:%M:%S.%f").alias("t")).first().t
    assert out == dt.datetime(2024, 5, 6, 7, 8, 9, 123456)
    with pytest.raises(ValueError, match="format applies"):
        convert(F.col("s"), "integer", "%Y")


def test_canonical_text(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 2, 3, 4, 5, 6), 1e10, 2.5, True, dt.date(2024, 1, 2))],
        "t timestamp_ntz, big double, x double, b boolean, d date",
    )
    row = df.select(
        canon(F.col("t"), T.TimestampNTZType()).alias("t"),
        canon(F.col("big"), T.DoubleType()).alias("big"),
        canon(F.col("x"), T.DoubleType()).alias("x"),
        canon(F.col("b"), T.BooleanType()).alias("b"),
        canon(F.col("d"), T.DateType()).alias("d"),
    ).first()
    assert tuple(row) == ("2024-01-02 03:04:05.000006", "1.0E10", "2.5", "true", "2024-01-02")
