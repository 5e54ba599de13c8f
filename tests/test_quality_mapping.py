"""Data quality and target mapping: F7, F8, F16, F17, F30-F32 and the
declared steps (quarantine, drift)."""
import pytest

from tablewright.operators import mapping, quality


def test_schema_check_refuses_and_flags(crates):
    """A lacking column ends the step or, as a flag, is named in every row."""
    wanted = {"code": "integer", "berth": "string", "tonnes": "float"}
    with pytest.raises(ValueError, match="berth.*tonnes"):
        quality.schema_validate(crates, wanted)
    assert quality.schema_validate(crates, wanted, fail_on_error=False).count() == crates.count()
    assert {r.check for r in quality.schema_validate(crates, wanted, flag="check").collect()} == {"MISSING:berth,tonnes"}
    assert {r.check for r in quality.schema_validate(crates, {"code": "integer"}, flag="check").collect()} == {"OK"}
    wrong = quality.schema_validate(crates, {"kilos": "string", "state": "string"}, flag="check", check_types=True)
    assert {r.check for r in wrong.collect()} == {"TYPE:kilos:double!=string"}


def test_exceptions(spark):  # F16, F17
    df = spark.createDataFrame([(11, -40), (12, 0), (13, None), (14, -2), (15, 6)], "id bigint, amount bigint")
    cond = {"column": "amount", "op": "lt", "value": 0}
    assert sorted(r.id for r in quality.exceptions([df], cond).collect()) == [11, 14]
    flagged = quality.exceptions([df], cond, flag="is_exception")
    assert [r.is_exception for r in flagged.orderBy("id").collect()] == [True, False, None, True, False]
    assert [r.id for r in quality.exceptions([df], cond, "rest").collect()] == [12, 15]


def test_exceptions_null_in_neither(spark):
    a = spark.createDataFrame([(1, -5)], "id bigint, amount bigint")
    b = spark.createDataFrame([(2,)], "id bigint")
    cond = {"column": "amount", "op": "lt", "value": 0}
    assert quality.exceptions([a, b], cond).count() == 1
    assert quality.exceptions([a, b], cond, "rest").count() == 0


def test_quarantine(spark):
    df = spark.createDataFrame([(1, None), (2, "BAD"), (3, ""), (4, "OK")], "id bigint, err string")
    valid, rejected = quality.quarantine(df, "err")
    assert sorted(r.id for r in valid.collect()) == [1, 3, 4] and [r.id for r in rejected.collect()] == [2]
    valid, _ = quality.quarantine(df, "err", include_valid_output=False)
    assert valid.count() == 0
    bools = spark.createDataFrame([(1, True), (2, False), (3, None)], "id bigint, bad boolean")
    v, r = quality.quarantine(bools, "bad")
    assert sorted(x.id for x in v.collect()) == [2, 3] and [x.id for x in r.collect()] == [1]


def test_drift(spark):
    df = spark.createDataFrame([(1, "a", 9)], "id bigint, name string, extra int")
    exp = {"id": "integer", "name": "string", "score": "float"}
    added = quality.handle_drift(df, "add_missing_columns", exp, 0)
    assert dict(added.dtypes)["score"] == "double" and added.first().score == 0.0
    dropped = quality.handle_drift(df, "drop_extra_columns", exp)
    assert dropped.columns == ["id", "name"]
    with pytest.raises(ValueError, match="drift"):
        quality.handle_drift(df, "fail", exp)
    assert quality.handle_drift(df, "fail", {"id": "integer", "name": "string", "extra": "integer"}).count() == 1


def test_mapping_basic(spark):  # F30
    df = spark.createDataFrame(
        [(7, "bolt", " M8 ", 2.5, 0.75), (8, "nut", None, None, 1.0), (9, None, "M6", 4.0, -4.0)],
        "part bigint, kind string, size string, net double, tax double",
    )
    maps = [
        {"target_column": "part_no", "source_column": "part", "nullable": False},
        {"target_column": "label", "operation": {"type": "concat", "columns": ["kind", "size"], "separator": "/"}},
        {"target_column": "gross", "operation": {"type": "add", "columns": ["net", "tax"]}},
        {"target_column": "size", "operation": {"type": "trim", "columns": ["size"]}},
        {"target_column": "batch", "literal": 3},
    ]
    out = mapping.map_target(df, maps)
    assert out.columns == ["part_no", "label", "gross", "size", "batch"]
    assert [tuple(r) for r in out.orderBy("part_no").collect()] == [(7, "bolt/ M8 ", 3.25, "M8", 3), (8, None, None, None, 3), (9, None, 0.0, "M6", 3)]


def test_mapping_missing_column(spark):  # F31
    df = spark.createDataFrame([(1,)], "id bigint")
    with pytest.raises(ValueError, match="missing columns"):
        mapping.map_target(df, [{"target_column": "x", "source_column": "missing"}])


def test_mapping_not_null_raises_at_run(spark):  # F32
    df = spark.createDataFrame([(None,)], "id bigint")
    out = mapping.map_target(df, [{"target_column": "x", "source_column": "id", "nullable": False}])
    with pytest.raises(Exception, match="non-nullable"):
        out.collect()


def test_mapping_operations_and_nulls(spark):
    df = spark.createDataFrame([(" a\t", None, 6, 0, "1"), ("b", "c", 7, 2, "x")], "s string, t string, a int, b int, n string")
    maps = [
        {"target_column": "cat", "operation": {"type": "concat", "columns": ["s", "t"], "separator": "-"}},
        {"target_column": "co", "operation": {"type": "coalesce", "columns": ["t", "s"]}},
        {"target_column": "tr", "operation": {"type": "trim", "columns": ["s"]}},
        {"target_column": "dv", "operation": {"type": "divide", "columns": ["a", "b"]}},
        {"target_column": "sub", "operation": {"type": "subtract", "columns": ["a", "b"]}},
        {"target_column": "mul", "operation": {"type": "multiply", "columns": ["a", "b"]}},
        {"target_column": "up", "operation": {"type": "upper", "columns": ["s"]}},
        {"target_column": "lo", "operation": {"type": "lower", "columns": ["t"]}},
        {"target_column": "nul", "literal": None},
    ]
    r = [tuple(x) for x in mapping.map_target(df, maps).collect()]
    assert r[0] == (None, " a\t", "a", None, 6, 0, " A\t", None, None)
    assert r[1] == ("b-c", "c", "b", 3.5, 5, 14, "B", "c", None)
    ieee = mapping.map_target(df, [{"target_column": "dv", "operation": {"type": "divide", "columns": ["a", "b"]}}], on_zero="ieee")
    assert ieee.first().dv == float("inf")


def test_mapping_validation():
    with pytest.raises(ValueError, match="exactly one"):  # F34
        mapping.validate_mappings([{"target_column": "a", "source_column": "x", "literal": 1}])
    with pytest.raises(ValueError, match="duplicate"):  # F37
        mapping.validate_mappings([{"target_column": "a", "literal": 1}, {"target_column": "a", "literal": 2}])
    with pytest.raises(ValueError, match="takes 2"):
        mapping.validate_mappings([{"target_column": "a", "operation": {"type": "subtract", "columns": ["x"]}}])
    with pytest.raises(ValueError, match="data_type"):
        mapping.validate_mappings([{"target_column": "a", "operation": {"type": "upper", "columns": ["x"], "data_type": "string"}}])
    with pytest.raises(ValueError, match="no mapping operation"):
        mapping.validate_mappings([{"target_column": "a", "operation": {"type": "pow", "columns": ["x"]}}])


def test_mapping_add_on_text_refused(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    with pytest.raises(ValueError, match="numeric"):
        mapping.map_target(df, [{"target_column": "z", "operation": {"type": "add", "columns": ["x", "y"]}}])


def test_mapping_cast_strict(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    out = mapping.map_target(df, [{"target_column": "n", "operation": {"type": "cast", "columns": ["v"], "data_type": "integer"}}])
    with pytest.raises(Exception):
        out.collect()


def test_all_literal_mapping_one_row_per_input(spark):  # N18
    df = spark.range(4)
    out = mapping.map_target(df, [{"target_column": "a", "literal": 1}, {"target_column": "b", "literal": "x"}])
    assert out.count() == 4


def test_integer_overflow_raises(spark):  # N9
    df = spark.createDataFrame([(9223372036854775807, 1)], "a bigint, b bigint")
    out = mapping.map_target(df, [{"target_column": "s", "operation": {"type": "add", "columns": ["a", "b"]}}])
    with pytest.raises(Exception, match="overflow|ARITHMETIC"):
        out.collect()


def test_schema_type_families(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    ok = quality.schema_validate(df, {"a": "integer", "b": "float", "c": "string"}, flag="chk", check_types=True)
    assert ok.first().chk == "OK"
    bad = quality.schema_validate(df, {"a": "date", "z": "string"}, flag="chk", check_types=True)
    assert bad.first().chk == "MISSING:z;TYPE:a:int!=date"
