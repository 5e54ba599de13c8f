"""Run specification: sources, ordered named steps, target, options.

A spec is plain data (a dict, e.g. parsed JSON).  ``parse_spec`` checks the
whole plan before any data is read: unknown fields, duplicate or shadowing
names, references to later steps, unknown actions, per-action config fields,
where the flag output mode is allowed, and the target mapping.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions.names import ident
from ..operators.mapping import validate_mappings
from .request import normalize_request

# The action names of the request contract.
ACTIONS = (
    "action-filter-dataset",
    "action-sort-dataset",
    "action-deduplicate",
    "action-aggregate",
    "action-sample-limit",
    "action-flatten-json",
    "action-explode-array",
    "action-pivot-unpivot",
    "action-format-convert",
    "action-schema-validate",
    "action-row-hash",
    "action-write-staging",
    "action-error-quarantine",
    "action-handle-drift",
    "action-merge-join",
    "action-union",
    "action-reconciliation",
    "action-delta-detection",
    "action-exception-extract",
    "action-cross-validate",
    "action-aggregate-multi",
    "action-rolling-join",
    "action-anti-join",
    "action-snapshot-diff",
)

# Actions that accept output mode "flag_column".
FLAG_ACTIONS = frozenset(
    {
        "action-filter-dataset",
        "action-schema-validate",
        "action-format-convert",
        "action-anti-join",
        "action-exception-extract",
        "action-reconciliation",
        "action-delta-detection",
        "action-snapshot-diff",
        "action-cross-validate",
        "action-row-hash",
    }
)

COMPARE_OPTIONS = {"compare_columns", "tolerance", "on_duplicate_keys", "columns", "split_full_join", "only_changes"}

# Per action: (required config keys, optional config keys, input count rule).
# Input rule: an int = exactly that many, "2+" = two or more, "1+" = one or more.
CONFIG_KEYS: dict[str, tuple[set[str], set[str], object]] = {
    "action-filter-dataset": ({"condition"}, set(), 1),
    "action-sort-dataset": ({"columns"}, {"order", "nulls_last"}, 1),
    "action-deduplicate": ({"subset"}, {"keep", "order_by"}, 1),
    "action-aggregate": ({"group_by", "metrics"}, {"order_by", "approx_median", "null_sum_as_zero", "large_groups", "chunk_rows"}, 1),
    "action-sample-limit": (set(), {"limit", "sample_fraction", "seed", "exact", "columns"}, 1),
    "action-flatten-json": ({"column"}, {"prefix", "drop_original", "schema"}, 1),
    "action-explode-array": ({"column"}, {"position"}, 1),
    "action-pivot-unpivot": ({"mode"}, {"index", "columns", "values", "agg", "pivot_values", "order_by"}, 1),
    "action-format-convert": ({"columns"}, set(), 1),
    "action-schema-validate": ({"schema"}, {"fail_on_error", "error_column", "check_types"}, 1),
    "action-row-hash": ({"columns", "target_column"}, {"algo"}, 1),
    "action-write-staging": ({"table"}, {"schema", "mode", "path"}, 1),
    "action-error-quarantine": ({"error_column", "table"}, {"schema", "include_valid_output", "path", "single_pass"}, 1),
    "action-handle-drift": ({"mode", "expected_schema"}, {"default_value"}, 1),
    "action-merge-join": ({"type", "on"}, {"suffix", "broadcast_max_bytes", "null_safe", "split_full_join"}, 2),
    "action-union": ({"type"}, {"align_schema"}, "2+"),
    "action-reconciliation": ({"keys"}, COMPARE_OPTIONS, 2),
    "action-delta-detection": ({"keys"}, COMPARE_OPTIONS, 2),
    "action-exception-extract": ({"condition"}, {"output_mode"}, "1+"),
    "action-cross-validate": ({"keys", "rules"}, {"on_duplicate_keys"}, 2),
    "action-aggregate-multi": ({"union_type", "group_by", "metrics"}, {"order_by", "align_schema", "large_groups", "chunk_rows"}, "2+"),
    "action-rolling-join": (
        {"on"},
        {"right_on", "by", "strategy", "tolerance", "suffix", "bucket_width", "rows_per_bucket", "max_buckets", "collapse_ties"},
        2,
    ),
    "action-anti-join": ({"on"}, {"broadcast_max_bytes"}, 2),
    "action-snapshot-diff": ({"keys"}, COMPARE_OPTIONS, 2),
}


def _fields(obj: dict, allowed: set[str], where: str) -> None:
    if not isinstance(obj, dict):
        raise ValueError(f"{where} must be an object")
    extra = set(obj) - allowed
    if extra:
        raise ValueError(f"{where}: unknown fields {sorted(extra)}")


@dataclass
class Source:
    name: str
    path: str | None = None
    format: str = "parquet"
    table: str | None = None
    jdbc: dict | None = None
    columns: list[str] | None = None
    filters: list[dict] | None = None
    options: dict | None = None


@dataclass
class Output:
    mode: str = "replace"
    target_column: str | None = None


@dataclass
class Step:
    action: str
    name: str
    inputs: list[str]
    config: dict
    output: Output | None = None

    @property
    def flag(self) -> str | None:
        return self.output.target_column if self.output and self.output.mode == "flag_column" else None


@dataclass
class Target:
    path: str | None = None
    table: str | None = None
    jdbc: dict | None = None
    format: str = "parquet"
    write_mode: str = "append"
    merge_keys: list[str] | None = None
    create_if_missing: bool = False
    column_mappings: list[dict] | None = None
    bucket_by: list | None = None  # [n, [keys]] for catalog tables


@dataclass
class Options:
    final_dataset: str | None = None
    max_rows_per_source: int | None = None
    collect_metrics: bool = True
    count_sources: bool = False


@dataclass
class Spec:
    sources: list[Source]
    steps: list[Step]
    target: Target | None = None
    options: Options = field(default_factory=Options)

    @property
    def final(self) -> str:
        return self.options.final_dataset or (self.steps[-1].name if self.steps else self.sources[-1].name)


def _parse_output(o: Any, action: str) -> Output | None:
    if o is None:
        return None
    _fields(o, {"mode", "target_column"}, f"{action} output")
    mode = o.get("mode", "replace")
    if mode not in ("replace", "flag_column"):
        raise ValueError(f"output.mode must be 'replace' or 'flag_column', not {mode!r}")
    tc = o.get("target_column")
    if mode == "flag_column":
        if not tc:
            raise ValueError("flag_column mode needs target_column, the name of the flag")
        if action not in FLAG_ACTIONS:
            raise ValueError(f"{action} does not support output mode 'flag_column'")
    if tc is not None:
        ident(tc)
    return Output(mode, tc)


def _check_inputs(action: str, n: int) -> None:
    rule = CONFIG_KEYS[action][2]
    ok = n == rule if isinstance(rule, int) else n >= int(str(rule)[0])
    if not ok:
        raise ValueError(f"{action} takes {rule} inputs, got {n}")


def parse_step(d: dict) -> Step:
    _fields(d, {"action", "name", "input", "config", "output"}, "action")
    action = d.get("action")
    if action not in ACTIONS:
        raise ValueError(f"Unsupported action: {action!r}")
    name = ident(d.get("name", ""))
    inputs = d.get("input") or []
    if not isinstance(inputs, list) or not inputs:
        raise ValueError(f"{name}: input must be a non-empty list")
    _check_inputs(action, len(inputs))
    cfg = d.get("config") or {}
    required, optional, _ = CONFIG_KEYS[action]
    _fields(cfg, required | optional, f"{name} config")
    missing = required - set(cfg)
    if missing:
        raise ValueError(f"{name} config: missing fields {sorted(missing)}")
    if action == "action-sample-limit" and (cfg.get("limit") is None) == (cfg.get("sample_fraction") is None):
        raise ValueError("give either limit or sample_fraction, not both or neither")
    return Step(action, name, list(inputs), dict(cfg), _parse_output(d.get("output"), action))


def parse_spec(d: dict) -> Spec:
    """Validate a whole request (flat form, or the database-request form
    rewritten by ``request.normalize_request``)."""
    d = normalize_request(d)
    _fields(d, {"version", "sources", "actions", "target", "options"}, "request")
    if str(d.get("version", "1.0")) != "1.0":
        raise ValueError("version must be '1.0'")
    sources = []
    for s in d.get("sources") or []:
        _fields(s, {"name", "path", "format", "table", "jdbc", "columns", "filters", "options"}, "source")
        sources.append(Source(**{**s, "name": ident(s.get("name", ""))}))
    if not sources:
        raise ValueError("at least one source is required")
    steps = [parse_step(a) for a in d.get("actions") or []]
    names = [s.name for s in sources]
    if len(set(names)) != len(names):
        raise ValueError("source names must be unique")
    known = set(names)
    for st in steps:
        if st.name in known:
            raise ValueError(f"action name {st.name!r} is not unique or shadows a source")
        for i in st.inputs:
            if i not in known:
                raise ValueError(f"{st.name}: input {i!r} is unavailable (unknown or defined later)")
        known.add(st.name)
    target = None
    if d.get("target") is not None:
        t = d["target"]
        _fields(t, {"path", "table", "jdbc", "format", "write_mode", "merge_keys", "create_if_missing", "column_mappings", "bucket_by"}, "target")
        target = Target(**t)
        if target.write_mode not in ("append", "overwrite", "merge"):
            raise ValueError(f"write_mode must be append, overwrite or merge, not {target.write_mode!r}")
        if target.column_mappings is not None:
            validate_mappings(target.column_mappings)
        if target.write_mode == "merge":
            if not target.merge_keys:
                raise ValueError("merge_keys are required for write_mode='merge'")
            if target.column_mappings is not None:
                mapped = {m["target_column"].lower() for m in target.column_mappings}
                bad = [k for k in target.merge_keys if k.lower() not in mapped]
                if bad:
                    raise ValueError(f"merge_keys must be mapped target columns: {bad}")
    opts = Options()
    if d.get("options") is not None:
        o = dict(d["options"])
        _fields(o, {"final_dataset", "max_rows_per_source", "collect_metrics", "count_sources", "parallel_load", "include_action_audit", "fail_mode"}, "options")
        # accepted for compatibility: sources are lazy and Spark schedules the
        # scans (parallel_load); plan-build times are always reported
        # (include_action_audit); fail_mode had no defined meaning
        if o.get("fail_mode", "fail_fast") not in ("fail_fast", "tolerant"):
            raise ValueError("fail_mode must be 'fail_fast' or 'tolerant'")
        for k in ("parallel_load", "include_action_audit", "fail_mode"):
            o.pop(k, None)
        opts = Options(**o)
    spec = Spec(sources, steps, target, opts)
    if spec.final not in known:
        raise ValueError(f"final_dataset {spec.final!r} is not defined")
    return spec
