"""Sources: Parquet (or any file format), catalog tables and JDBC.

A source is a lazy DataFrame with an optional column list and ANDed leaf
filters.  Catalyst prunes the columns into the scan's ``ReadSchema`` and
pushes the filters into ``PushedFilters`` (Parquet row groups, JDBC WHERE),
so no rows pass through the driver.  JDBC reads can be split into
``num_partitions`` range queries on a column; where its bounds are not given
the database itself is asked for them (``split_points``).
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.names import field_type, idents, require_columns
from ..functions.predicates import condition
from ..operators.rows import limit_rows
from .merges import live_files

# Fixed value: rows fetched per JDBC round trip unless the source says otherwise.
DEFAULT_FETCH_SIZE = 10_000

#: Bins counted for each range of a split read.
BINS = 64


@dataclass
class JdbcOptions:
    url: str
    table: str
    properties: Mapping[str, str] = field(default_factory=dict)
    partition_column: str | None = None
    lower_bound: int | None = None
    upper_bound: int | None = None
    num_partitions: int | None = None
    fetch_size: int = DEFAULT_FETCH_SIZE


def _ask(spark: SparkSession, opts: JdbcOptions, query: str) -> list:
    return spark.read.jdbc(opts.url, f"({query}) tw_q", properties=dict(opts.properties)).collect()


def split_points(spark: SparkSession, opts: JdbcOptions) -> list[float]:
    """Points that cut a numeric column into about ``num_partitions`` ranges
    of equally many rows, from two aggregates of the database: its least and
    greatest value, then the rows of ``BINS`` equal widths for each range.  The
    points lie on bin borders; at most so many bins come back."""
    column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(opts.url).quoteIdentifier(opts.partition_column)
    (ends,) = _ask(spark, opts, f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {opts.table}")
    if ends[0] is None or ends[0] == ends[1]:
        return []
    low, high = float(ends[0]), float(ends[1])
    n = BINS * opts.num_partitions
    width = (high - low) / n
    place = f"FLOOR((CAST({column} AS DOUBLE PRECISION) - {low!r}) / {width!r})"
    bins = _ask(spark, opts, f"SELECT b, COUNT(*) AS n FROM (SELECT {place} AS b FROM {opts.table} WHERE {column} IS NOT NULL) x GROUP BY b")
    counts = sorted((float(b), int(k)) for b, k in bins)
    total, so_far, points = sum(k for _, k in counts), 0, []
    for b, k in counts[:-1]:
        so_far += k
        if so_far * opts.num_partitions >= total * (len(points) + 1):
            points.append(low + (b + 1) * width)
    return sorted(set(points))[: opts.num_partitions - 1]


def split_predicates(column: str, points: Sequence[float]) -> list[str]:
    """Disjoint conditions that hold for every row once, nulls among them."""
    if not points:
        return ["1=1"]
    first, *inner = points
    parts = [f"{column} < {first!r}"]
    parts += [f"{column} >= {a!r} AND {column} < {b!r}" for a, b in zip(points, inner)]
    return [*parts, f"{column} >= {points[-1]!r}", f"{column} IS NULL"]


def read_jdbc(spark: SparkSession, opts: JdbcOptions) -> DataFrame:
    props = {"fetchsize": str(opts.fetch_size), **dict(opts.properties)}
    if opts.partition_column:
        if not opts.num_partitions:
            raise ValueError("a partitioned JDBC read needs num_partitions")
        if (opts.lower_bound is None) != (opts.upper_bound is None):
            raise ValueError("a partitioned JDBC read needs both lower_bound and upper_bound, or neither")
        if opts.lower_bound is None:
            whole = spark.read.jdbc(opts.url, opts.table, properties=props)
            if not isinstance(field_type(whole, opts.partition_column), T.NumericType):
                raise ValueError(f"give bounds to split on {opts.partition_column!r}, which is not numeric")
            column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(opts.url).quoteIdentifier(opts.partition_column)
            return spark.read.jdbc(opts.url, opts.table, predicates=split_predicates(column, split_points(spark, opts)), properties=props)
        return spark.read.jdbc(
            opts.url,
            opts.table,
            column=opts.partition_column,
            lowerBound=opts.lower_bound,
            upperBound=opts.upper_bound,
            numPartitions=opts.num_partitions,
            properties=props,
        )
    return spark.read.jdbc(opts.url, opts.table, properties=props)


def read_source(
    spark: SparkSession,
    *,
    path: str | None = None,
    format: str = "parquet",
    table: str | None = None,
    jdbc: JdbcOptions | Mapping | None = None,
    columns: Sequence[str] | None = None,
    filters: Sequence[dict] | None = None,
    limit: int | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Open exactly one of ``path`` / ``table`` / ``jdbc`` as a lazy DataFrame."""
    given = [x for x in (path, table, jdbc) if x is not None]
    if len(given) != 1:
        raise ValueError("a source needs exactly one of path, table, jdbc")
    if path is not None:
        reader, live = spark.read.format(format).options(**dict(options or {})), live_files(spark, path)
        df = reader.load(path) if live is None else reader.option("basePath", path).load(live)
    elif table is not None:
        df = spark.table(table)
    else:
        df = read_jdbc(spark, jdbc if isinstance(jdbc, JdbcOptions) else JdbcOptions(**dict(jdbc)))
    if filters:
        for f in filters:
            if not isinstance(f, dict) or "and" in f or "or" in f:
                raise ValueError("source filters are leaf conditions {column, op, value}")
        df = df.filter(condition({"and": list(filters)}, df))
    if columns:
        cols = idents(columns)
        require_columns(df, cols, where="source")
        df = df.select(*cols)
    if limit is not None:
        df = limit_rows(df, int(limit))
    return df


def read_tables(spark: SparkSession, base: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """``{name: spark.read.parquet(f"{base}/{name}.parquet")}`` — lazy."""
    return {n: spark.read.parquet(f"{base.rstrip('/')}/{n}.parquet") for n in names}
