"""Flatten, explode, pivot, unpivot."""
import pytest
from pyspark.sql import functions as F

from tablewright.operators import reshape


def test_flatten_struct_and_json(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": 2}'), (3, None)], "id bigint, j string")
    out = reshape.flatten(df, "j", prefix="j_", drop_original=True)
    assert out.columns == ["id", "j_a", "j_b"]
    assert sorted((r.id, r.j_a, r.j_b) for r in out.collect() if r.j_a is not None) == [(1, 1, "x"), (2, 2, None)]
    given = reshape.flatten(df, "j", schema="a INT")
    assert given.columns == ["id", "j", "a"]
    st = df.select("id", F.struct(F.lit(1).alias("p"), F.lit("q").alias("q")).alias("s"))
    assert reshape.flatten(st, "s").columns == ["id", "s", "p", "q"]
    with pytest.raises(ValueError, match="already exist"):
        reshape.flatten(st.withColumn("p", F.lit(0)), "s")


def test_explode_outer(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id bigint, xs array<string>")
    out = reshape.explode(df, "xs")
    assert sorted((r.id, r.xs or "") for r in out.collect()) == [(1, "a"), (1, "b"), (2, ""), (3, "")]
    pos = reshape.explode(df, "xs", position="i")
    assert pos.columns == ["id", "i", "xs"]
    with pytest.raises(ValueError):
        reshape.explode(df, "id")


def test_pivot_unpivot_roundtrip(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "k bigint, c string, v double")
    wide = reshape.pivot(df, ["k"], "c", ["v"], "sum", pivot_values=["a", "b"])
    assert wide.columns == ["k", "a", "b"]
    long = reshape.unpivot(wide, ["k"], ["a", "b"], "c", "v").filter("v is not null")
    assert sorted(tuple(r) for r in long.collect()) == sorted(tuple(r) for r in df.collect())
    two = reshape.pivot(df, ["k"], "c", ["v"], "count")
    assert set(two.columns) == {"k", "a", "b"}


def test_pivot_several_values(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 2)], "k bigint, c string, v double, w int")
    out = reshape.pivot(df, ["k"], "c", ["v", "w"], "max", pivot_values=["a"])
    assert out.columns == ["k", "a_v", "a_w"]


def test_unpivot_types(spark):
    df = spark.createDataFrame([(1, 2, 3.5, "x")], "k bigint, i int, d double, s string")
    assert dict(reshape.unpivot(df, ["k"], ["i", "d"]).dtypes)["value"] == "double"
    assert dict(reshape.unpivot(df, ["k"], ["i", "s"]).dtypes)["value"] == "string"
