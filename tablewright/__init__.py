"""tablewright: table steps, dataset comparison and data-quality checks as
lazy Spark DataFrame transformations.

Every step is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions; planning, shuffling and spilling are Spark's.
"""
from .functions.predicates import condition
from .operators.aggregate import aggregate, aggregate_multi
from .operators.compare import cross_validate, delta, reconcile, snapshot_diff
from .operators.joins import anti_join, asof_join, merge_join, semi_join
from .operators.mapping import map_target
from .operators.quality import exceptions, handle_drift, quarantine, schema_validate
from .operators.reshape import explode, flatten, pivot, unpivot
from .operators.rows import deduplicate, filter_rows, format_convert, limit_rows, row_hash, sample_rows, sort_rows
from .operators.setops import union

__version__ = "0.1.0"

__all__ = [
    "aggregate", "aggregate_multi", "anti_join", "asof_join", "condition", "cross_validate", "deduplicate", "delta",
    "exceptions", "explode", "filter_rows", "flatten", "format_convert", "handle_drift", "limit_rows", "map_target",
    "merge_join", "pivot", "quarantine", "reconcile", "row_hash", "sample_rows", "schema_validate", "semi_join",
    "snapshot_diff", "sort_rows", "union", "unpivot",
]
