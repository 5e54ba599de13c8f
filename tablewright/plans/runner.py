"""Run a spec: open sources, apply steps in order, map, write, report.

``build`` turns the spec into named lazy DataFrames (Spark plans the whole
DAG at the write).  Two steps have deliberate side effects: write-staging
(writes, then continues from the written copy) and error-quarantine (tags and
stages its rows in one run of the plan, ``single_pass: false`` leaves that out;
its rejected rows are written by ``run`` before the target).

Row order: first/last de-duplication and metrics need an ordering.  The
last sort step's columns are carried through row-local steps and dropped at
joins, unions and aggregates; an explicit ``order_by`` always wins.
"""
from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as agg_ops
from ..operators import compare, joins, quality, reshape, rows, setops
from ..functions.names import ident
from ..operators.mapping import map_target
from ..sources.readers import read_source
from ..sources.sinks import WriteReport, new_scratch_path, observed_rows, write, write_quarantine, write_staging
from .spec import COMPARE_OPTIONS, Spec, Step, parse_spec

# actions after which a carried sort order still holds
_ORDER_KEEPING = {
    "action-filter-dataset",
    "action-row-hash",
    "action-format-convert",
    "action-schema-validate",
    "action-sample-limit",
    "action-handle-drift",
    "action-flatten-json",
    "action-sort-dataset",
}


_GROUP_SIZE = {"large_groups", "chunk_rows"}


def _given(config: dict, names: set[str]) -> dict:
    return {k: config[k] for k in names & set(config)}


@dataclass
class Built:
    datasets: dict[str, DataFrame]
    final: DataFrame
    pending: list = field(default_factory=list)  # (label, DataFrame, target kwargs)
    step_ms: dict[str, float] = field(default_factory=dict)


@dataclass
class RunReport:
    final_dataset: str
    columns: list[str]
    rows_written: int | None
    target: str | None
    source_rows: dict[str, int | None]
    side_writes: dict[str, int]
    plan_build_ms: dict[str, float]
    duration_s: float


def _apply(step: Step, ins: list[DataFrame], order: list[str] | None, built: Built) -> DataFrame:
    a, c, flag = step.action, step.config, step.flag
    x = ins[0]
    if a == "action-filter-dataset":
        return rows.filter_rows(x, c["condition"], flag=flag)
    if a == "action-sort-dataset":
        return rows.sort_rows(x, c["columns"], c.get("order", "asc"), c.get("nulls_last", True))
    if a == "action-deduplicate":
        return rows.deduplicate(x, c["subset"], c.get("keep", "first"), c.get("order_by") or order)
    if a == "action-aggregate":
        return agg_ops.aggregate(
            x, c["group_by"], c["metrics"], order_by=c.get("order_by") or order,
            approx_median=c.get("approx_median", False), null_sum_as_zero=c.get("null_sum_as_zero", False), **_given(c, _GROUP_SIZE),
        )
    if a == "action-sample-limit":
        if c.get("limit") is not None:
            return rows.limit_rows(x, c["limit"])
        return rows.sample_rows(x, c["sample_fraction"], c.get("seed"), exact=c.get("exact", False), columns=c.get("columns"))
    if a == "action-flatten-json":
        return reshape.flatten(x, c["column"], c.get("prefix", ""), c.get("drop_original", False), schema=c.get("schema"))
    if a == "action-explode-array":
        return reshape.explode(x, c["column"], position=c.get("position"))
    if a == "action-pivot-unpivot":
        if c["mode"] == "pivot":
            if not c.get("columns") or len(c["columns"]) != 1:
                raise ValueError("pivot needs exactly one pivot column in 'columns'")
            return reshape.pivot(x, c.get("index", []), c["columns"][0], c.get("values", []), c.get("agg") or "first",
                                 pivot_values=c.get("pivot_values"), order_by=c.get("order_by") or order)
        if c["mode"] == "unpivot":
            return reshape.unpivot(x, c.get("index", []), c.get("columns") or c.get("values") or None)
        raise ValueError("pivot mode must be 'pivot' or 'unpivot'")
    if a == "action-format-convert":
        return rows.format_convert(x, c["columns"], flag=flag)
    if a == "action-schema-validate":
        return quality.schema_validate(x, c["schema"], c.get("fail_on_error", True), flag=flag, check_types=c.get("check_types", False))
    if a == "action-row-hash":
        target = step.output.target_column if step.output and step.output.target_column else c["target_column"]
        return rows.row_hash(x, c["columns"], target, c.get("algo", "sha256"))
    if a == "action-write-staging":
        if c.get("path") or not c.get("schema"):
            path = c.get("path") or new_scratch_path(x.sparkSession, f"staging-{c['table']}")
            return write_staging(x, path, c.get("mode", "overwrite"))
        # schema + table name a catalog table (its namespace is created if absent)
        spark = x.sparkSession
        if not spark.catalog.databaseExists(ident(c["schema"])):
            spark.sql(f"CREATE DATABASE IF NOT EXISTS `{c['schema']}`")
        return write_staging(x, mode=c.get("mode", "overwrite"), table=f"{c['schema']}.{ident(c['table'])}")
    if a == "action-error-quarantine":
        if c.get("include_valid_output", True) and c.get("single_pass", True):
            valid, rejected, _ = quality.quarantine_once(x, c["error_column"])  # both sides are written: run the plan once
        else:
            valid, rejected = quality.quarantine(x, c["error_column"], c.get("include_valid_output", True))
        if c.get("path"):
            target = {"path": c["path"]}
        else:
            if c.get("schema") and not x.sparkSession.catalog.databaseExists(ident(c["schema"])):
                x.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS `{c['schema']}`")
            target = {"table": ".".join(p for p in (c.get("schema"), ident(c["table"])) if p)}
        built.pending.append((step.name, rejected, target))
        return valid
    if a == "action-handle-drift":
        return quality.handle_drift(x, c["mode"], c["expected_schema"], c.get("default_value"))
    if a == "action-merge-join":
        return joins.merge_join(x, ins[1], c["on"], c["type"], c.get("suffix", "_right"), null_safe=c.get("null_safe", False),
                                broadcast_max_bytes=c.get("broadcast_max_bytes"), split_full_join=c.get("split_full_join"))
    if a == "action-union":
        return setops.union(ins, c["type"], align_schema=c.get("align_schema", False))
    if a == "action-reconciliation":
        return compare.reconcile(x, ins[1], c["keys"], status_column=flag or "recon_status", **_given(c, COMPARE_OPTIONS))
    if a == "action-delta-detection":
        return compare.delta(x, ins[1], c["keys"], status_column=flag or "change_type", **_given(c, COMPARE_OPTIONS))
    if a == "action-snapshot-diff":
        return compare.snapshot_diff(x, ins[1], c["keys"], status_column=flag or "change_status", **_given(c, COMPARE_OPTIONS))
    if a == "action-exception-extract":
        return quality.exceptions(ins, c["condition"], c.get("output_mode", "exceptions_only"), flag=flag)
    if a == "action-cross-validate":
        return compare.cross_validate(x, ins[1], c["keys"], c["rules"], status_column=flag or "validation_status",
                                      on_duplicate_keys=c.get("on_duplicate_keys", "allow"))
    if a == "action-aggregate-multi":
        return agg_ops.aggregate_multi(ins, c["union_type"], c["group_by"], c["metrics"], align_schema=c.get("align_schema", False),
                                       order_by=c.get("order_by"), **_given(c, _GROUP_SIZE))
    if a == "action-rolling-join":
        return joins.asof_join(x, ins[1], c["on"], right_on=c.get("right_on"), by=c.get("by"), strategy=c.get("strategy", "backward"),
                               tolerance=c.get("tolerance"), suffix=c.get("suffix", "_right"), bucket_width=c.get("bucket_width"),
                               rows_per_bucket=c.get("rows_per_bucket"), max_buckets=c.get("max_buckets"),
                               collapse_ties=c.get("collapse_ties"))
    if a == "action-anti-join":
        return joins.anti_join(x, ins[1], c["on"], flag=flag, broadcast_max_bytes=c.get("broadcast_max_bytes"))
    raise ValueError(f"Unsupported action: {a!r}")


def _source(spark: SparkSession, spec: Spec, s) -> DataFrame:
    return read_source(spark, path=s.path, format=s.format, table=s.table, jdbc=s.jdbc, columns=s.columns,
                       filters=s.filters, limit=spec.options.max_rows_per_source, options=s.options)


def _read_by(spec: Spec) -> set[str]:
    """Names of the datasets that the final one is made from."""
    deps = {st.name: st.inputs for st in spec.steps}
    reach, todo = set(), [spec.final]
    while todo:
        n = todo.pop()
        if n not in reach:
            reach.add(n)
            todo.extend(deps.get(n, []))
    return reach


def build(spark: SparkSession, spec: Spec | dict) -> Built:
    spec = parse_spec(spec) if isinstance(spec, dict) else spec
    data: dict[str, DataFrame] = {}
    orders: dict[str, list[str] | None] = {}
    built = Built(data, None)  # type: ignore[arg-type]
    for s in spec.sources:
        df = _source(spark, spec, s)
        data[s.name] = df
        orders[s.name] = None
    for st in spec.steps:
        t0 = time.perf_counter()
        ins = [data[i] for i in st.inputs]
        carried = orders[st.inputs[0]] if len(st.inputs) == 1 and st.action in _ORDER_KEEPING | {"action-deduplicate", "action-aggregate", "action-pivot-unpivot"} else None
        try:
            data[st.name] = _apply(st, ins, carried, built)
        except Exception as e:
            e.add_note(f"while building step {st.name!r} ({st.action})")  # names the failed step
            raise
        if st.action == "action-sort-dataset":
            orders[st.name] = list(st.config["columns"])
        elif st.action in _ORDER_KEEPING and len(st.inputs) == 1:
            orders[st.name] = orders[st.inputs[0]]
        else:
            orders[st.name] = None
        built.step_ms[st.name] = (time.perf_counter() - t0) * 1000.0
    final = data[spec.final]
    if spec.target is not None and spec.target.column_mappings:
        final = map_target(final, spec.target.column_mappings)
    built.final = final
    return built


def run(spark: SparkSession, spec: Spec | dict) -> RunReport:
    """Build, write quarantined rows, write the final dataset, report."""
    t0 = time.perf_counter()
    spec = parse_spec(spec) if isinstance(spec, dict) else spec
    built = build(spark, spec)
    side: dict[str, int] = {}
    for label, rejected, target in built.pending:
        side[label] = write_quarantine(rejected, **target).rows_written
    report: WriteReport | None = None
    if spec.target is not None:
        t = spec.target
        report = write(built.final, path=t.path, table=t.table, jdbc=t.jdbc, format=t.format, mode=t.write_mode,
                       merge_keys=t.merge_keys, create_if_missing=t.create_if_missing,
                       bucket_by=(t.bucket_by[0], t.bucket_by[1]) if t.bucket_by else None)
    # a counter inside the plan would keep filters from reaching the scan, so
    # counts that are asked for are jobs of their own, over no columns
    counts = {}
    if spec.options.count_sources:
        reach = _read_by(spec)
        counts = {s.name: _source(spark, spec, s).count() for s in spec.sources if s.name in reach}
    return RunReport(spec.final, list(built.final.columns), report.rows_written if report else None,
                     report.target if report else None, counts, side, built.step_ms, time.perf_counter() - t0)
