"""Registered queries: one per operator of the inventory, each over whole
given tables (or data Spark derives from them), plus the DuckDB SQL that
computes the same result for the correctness check.

Every query is ``fn(spark, sf_dir) -> DataFrame``.  Output column names are
identical between the Spark result and the SQL.  Floating sums and averages
are rounded on both sides (summation order differs between engines).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as agg_ops
from ..operators import compare, joins, mapping, quality, reshape, rows, setops
from ..sources.readers import read_source
from ..sources.sinks import new_scratch_path, upsert_path, write_staging
from ..streaming.streams import dedup_stream, open_stream, quarantine_stream, upsert_stream
from . import variants as V
from .runner import build, run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return V.table(spark, d, name)


def with_cte(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


LINEITEM_OTHERS = [
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]

# ------------------------------------------------------------------ filters


@register(
    "filter_and_or",
    """SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O'
       AND (l_quantity > 30 OR l_discount >= 0.05) AND l_tax < 0.08 AND l_quantity <= 45""",
)
def q_filter_and_or(spark, d):
    cond = {
        "and": [
            {"column": "l_returnflag", "op": "eq", "value": "R"},
            {"column": "l_linestatus", "op": "neq", "value": "O"},
            {"or": [{"column": "l_quantity", "op": "gt", "value": 30}, {"column": "l_discount", "op": "gte", "value": 0.05}]},
            {"column": "l_tax", "op": "lt", "value": 0.08},
            {"column": "l_quantity", "op": "lte", "value": 45},
        ]
    }
    return rows.filter_rows(T(spark, d, "lineitem"), cond)


@register(
    "filter_in_not_in",
    "SELECT * FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority NOT IN ('5-LOW')",
)
def q_filter_in(spark, d):
    cond = {
        "and": [
            {"column": "o_orderstatus", "op": "in", "value": ["O", "F", None]},
            {"column": "o_orderpriority", "op": "not_in", "value": ["5-LOW"]},
        ]
    }
    return rows.filter_rows(T(spark, d, "orders"), cond)


@register("filter_is_null", with_cte(V.ORDERS_TGT_SQL) + "SELECT * FROM orders_tgt WHERE o_orderstatus IS NULL")
def q_filter_is_null(spark, d):
    return rows.filter_rows(V.orders_tgt(T(spark, d, "orders")), {"column": "o_orderstatus", "op": "is_null"})


@register(
    "filter_is_not_null",
    with_cte(V.ORDERS_TGT_SQL)
    + "SELECT o_orderpriority, count(*) AS n FROM orders_tgt WHERE o_orderstatus IS NOT NULL GROUP BY o_orderpriority",
)
def q_filter_not_null(spark, d):
    kept = rows.filter_rows(V.orders_tgt(T(spark, d, "orders")), {"column": "o_orderstatus", "op": "is_not_null"})
    return agg_ops.aggregate(kept, ["o_orderpriority"], [{"column": "o_orderkey", "agg": "len", "alias": "n"}])


@register("filter_flag", "SELECT *, c_acctbal > 5000 AS is_rich FROM customer")
def q_filter_flag(spark, d):
    return rows.filter_rows(T(spark, d, "customer"), {"column": "c_acctbal", "op": "gt", "value": 5000}, flag="is_rich")


# ------------------------------------------------------------------ sources


@register(
    "source_projection",
    "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
)
def q_source_projection(spark, d):
    return read_source(
        spark,
        path=f"{d}/orders.parquet",
        columns=["o_orderkey", "o_totalprice", "o_orderdate"],
        filters=[{"column": "o_orderstatus", "op": "eq", "value": "F"}, {"column": "o_totalprice", "op": "gt", "value": 100000}],
    )


@register(
    "source_row_cap",
    """SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' LIMIT 1000) t""",
)
def q_source_cap(spark, d):
    src = read_source(
        spark, path=f"{d}/orders.parquet", columns=["o_orderkey"], filters=[{"column": "o_orderstatus", "op": "eq", "value": "F"}], limit=1000
    )
    return src.agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ sort / limit / sample


@register("sort_top_k", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100")
def q_sort_top_k(spark, d):
    return rows.limit_rows(rows.sort_rows(T(spark, d, "orders"), ["o_totalprice", "o_orderkey"], "desc"), 100)


@register(
    "sample_exact",
    """WITH h AS (SELECT *, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')) AS _h FROM orders),
       r AS (SELECT *, row_number() OVER (ORDER BY _h) AS _rn FROM h)
       SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM r
       WHERE _rn <= (SELECT floor(count(*) * 0.1) FROM orders)""",
)
def q_sample_exact(spark, d):
    return rows.sample_rows(T(spark, d, "orders"), 0.1, 42, exact=True, columns=["o_orderkey"])


@register(
    "sample_bernoulli",
    f"""SELECT * FROM orders
        WHERE substr(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), 1, 8) < '{int(0.1 * (1 << 32)):08x}'""",
)
def q_sample_bernoulli(spark, d):
    return rows.sample_rows(T(spark, d, "orders"), 0.1, 42, columns=["o_orderkey"])


# ------------------------------------------------------------------ de-duplicate

_DEDUP_ORDER = ", ".join(f"{c} NULLS FIRST" for c in ["l_shipdate"] + LINEITEM_OTHERS)
_DEDUP_ORDER_DESC = ", ".join(f"{c} DESC NULLS LAST" for c in ["l_shipdate"] + LINEITEM_OTHERS)


@register(
    "dedup_first",
    f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_DEDUP_ORDER}) = 1",
)
def q_dedup_first(spark, d):
    return rows.deduplicate(T(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "first", order_by=["l_shipdate"])


@register(
    "dedup_last",
    f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_DEDUP_ORDER_DESC}) = 1",
)
def q_dedup_last(spark, d):
    return rows.deduplicate(T(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "last", order_by=["l_shipdate"])


@register("dedup_any", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def q_dedup_any(spark, d):
    return rows.deduplicate(T(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "any").select("l_orderkey", "l_linenumber")


@register(
    "dedup_none",
    "SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1",
)
def q_dedup_none(spark, d):
    return rows.deduplicate(T(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "none")


# ------------------------------------------------------------------ aggregates


@register(
    "agg_basic",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
              min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, round(avg(l_discount), 6) AS avg_disc,
              count(l_orderkey) AS count_order
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def q_agg_basic(spark, d):
    out = agg_ops.aggregate(
        T(spark, d, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        [
            {"column": "l_quantity", "agg": "sum", "alias": "sum_qty"},
            {"column": "l_extendedprice", "agg": "sum", "alias": "sum_price"},
            {"column": "l_extendedprice", "agg": "min", "alias": "min_price"},
            {"column": "l_extendedprice", "agg": "max", "alias": "max_price"},
            {"column": "l_discount", "agg": "mean", "alias": "avg_disc"},
            {"column": "l_orderkey", "agg": "count", "alias": "count_order"},
        ],
    )
    return out.withColumns({"sum_qty": F.round("sum_qty", 2), "sum_price": F.round("sum_price", 2), "avg_disc": F.round("avg_disc", 6)})


@register(
    "agg_median_nunique",
    with_cte(V.ORDERS_TGT_SQL)
    + """SELECT o_orderpriority, median(o_totalprice) AS median_price,
              count(DISTINCT o_orderstatus) + max(CASE WHEN o_orderstatus IS NULL THEN 1 ELSE 0 END) AS n_status
       FROM orders_tgt GROUP BY o_orderpriority""",
)
def q_agg_median(spark, d):
    return agg_ops.aggregate(
        V.orders_tgt(T(spark, d, "orders")),
        ["o_orderpriority"],
        [
            {"column": "o_totalprice", "agg": "median", "alias": "median_price"},
            {"column": "o_orderstatus", "agg": "n_unique", "alias": "n_status"},
        ],
    )


@register(
    "agg_first_last",
    """SELECT user_id, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value,
              arg_min(event_type, ts) AS first_type
       FROM events GROUP BY user_id""",
)
def q_agg_first_last(spark, d):
    return agg_ops.aggregate(
        T(spark, d, "events"),
        ["user_id"],
        [
            {"column": "value", "agg": "first", "alias": "first_value"},
            {"column": "value", "agg": "last", "alias": "last_value"},
            {"column": "event_type", "agg": "first", "alias": "first_type"},
        ],
        order_by=["ts"],
    )


@register(
    "agg_global",
    """SELECT count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS total_price, min(o_orderdate) AS first_date,
              max(o_orderdate) AS last_date, count(DISTINCT o_custkey) + max(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END) AS n_customers
       FROM orders""",
)
def q_agg_global(spark, d):
    out = agg_ops.aggregate(
        T(spark, d, "orders"),
        [],
        [
            {"column": "o_orderkey", "agg": "count", "alias": "n_orders"},
            {"column": "o_totalprice", "agg": "sum", "alias": "total_price"},
            {"column": "o_orderdate", "agg": "min", "alias": "first_date"},
            {"column": "o_orderdate", "agg": "max", "alias": "last_date"},
            {"column": "o_custkey", "agg": "n_unique", "alias": "n_customers"},
        ],
    )
    return out.withColumn("total_price", F.round("total_price", 2))


@register(
    "agg_extended",
    """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS qty_std, round(var_samp(l_quantity), 6) AS qty_var,
              bool_or(l_discount >= 0.05) AS any_discount, bool_and(l_discount >= 0.05) AS all_discount,
              count(*) FILTER (WHERE l_tax IS NULL) AS tax_nulls, count(*) AS n_rows
       FROM lineitem GROUP BY l_returnflag""",
)
def q_agg_extended(spark, d):
    li = T(spark, d, "lineitem").withColumn("is_discounted", F.col("l_discount") >= 0.05)
    out = agg_ops.aggregate(
        li,
        ["l_returnflag"],
        [
            {"column": "l_quantity", "agg": "std", "alias": "qty_std"},
            {"column": "l_quantity", "agg": "var", "alias": "qty_var"},
            {"column": "is_discounted", "agg": "any", "alias": "any_discount"},
            {"column": "is_discounted", "agg": "all", "alias": "all_discount"},
            {"column": "l_tax", "agg": "null_count", "alias": "tax_nulls"},
            {"column": "l_tax", "agg": "len", "alias": "n_rows"},
        ],
    )
    return out.withColumns({"qty_std": F.round("qty_std", 6), "qty_var": F.round("qty_var", 6)})


@register(
    "agg_large_groups",
    """WITH n AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY ALL),
          top AS (SELECT l_returnflag, l_quantity AS qty_mode FROM n
                  QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_quantity) = 1)
       SELECT l.l_returnflag, median(l_extendedprice) AS price_median, any_value(qty_mode) AS qty_mode, count(*) AS n_rows
       FROM lineitem l JOIN top ON l.l_returnflag = top.l_returnflag GROUP BY l.l_returnflag""",
)
def q_agg_large_groups(spark, d):
    """Exact median and mode without a buffer that holds a group."""
    metrics = [
        {"column": "l_extendedprice", "agg": "median", "alias": "price_median"},
        {"column": "l_quantity", "agg": "mode", "alias": "qty_mode"},
        {"column": "l_tax", "agg": "len", "alias": "n_rows"},
    ]
    return agg_ops.aggregate(T(spark, d, "lineitem"), ["l_returnflag"], metrics, large_groups=True)


@register(
    "agg_median_global",
    "SELECT median(l_extendedprice) AS price_median, median(l_quantity) AS qty_median FROM lineitem",
)
def q_agg_median_global(spark, d):
    """All rows are one group."""
    metrics = [{"column": "l_extendedprice", "agg": "median", "alias": "price_median"}, {"column": "l_quantity", "agg": "median", "alias": "qty_median"}]
    return agg_ops.aggregate(T(spark, d, "lineitem"), [], metrics, large_groups=True)


@register(
    "agg_implode",
    """WITH n AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i FROM orders)
       SELECT o_orderstatus, i // 500 AS keys_chunk, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY i) AS keys, count(*) AS n
       FROM n GROUP BY ALL""",
)
def q_agg_implode(spark, d):
    """A group's values in numbered lists of at most 500."""
    metric = [{"column": "o_orderkey", "agg": "implode", "alias": "keys"}]
    out = agg_ops.aggregate(T(spark, d, "orders"), ["o_orderstatus"], metric, order_by=["o_orderkey"], chunk_rows=500)
    return out.withColumns({"keys": F.array_join("keys", ","), "n": F.size("keys").cast("long")})


@register(
    "agg_sketch",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, true AS merged_within_5_percent, true AS approx_within_5_percent
       FROM lineitem GROUP BY l_returnflag""",
)
def q_agg_sketch(spark, d):
    """Distinct counts from sketches of two loads merged later, and from one
    pass, against the exact ones: within three standard errors (1.04 / 64 each)."""
    li = T(spark, d, "lineitem")
    loads = [li.where(F.col("l_orderkey") % 2 == i) for i in (0, 1)]
    stored = [agg_ops.aggregate(x, ["l_returnflag"], [{"column": "l_partkey", "agg": "sketch", "alias": "parts"}]) for x in loads]
    merged = agg_ops.merge_sketches(stored[0].unionByName(stored[1]), ["l_returnflag"], "parts", estimate="merged").drop("parts")
    metrics = [
        {"column": "l_partkey", "agg": "n_unique", "alias": "n_parts"}, {"column": "l_partkey", "agg": "approx_n_unique", "alias": "approx"},
    ]
    both = agg_ops.aggregate(li, ["l_returnflag"], metrics).join(merged, "l_returnflag")
    near = lambda c: F.abs(F.col(c) / F.col("n_parts") - 1) <= 0.05
    return both.select("l_returnflag", "n_parts", near("merged").alias("merged_within_5_percent"), near("approx").alias("approx_within_5_percent"))


@register(
    "agg_moments",
    """WITH s AS (SELECT l_returnflag, avg(l_quantity) AS mu, count(*) AS n FROM lineitem GROUP BY l_returnflag)
       SELECT l.l_returnflag,
              round(sqrt(any_value(s.n)) * sum(power(l.l_quantity - s.mu, 3)) / power(sum(power(l.l_quantity - s.mu, 2)), 1.5), 6) AS qty_skew,
              round(any_value(s.n) * sum(power(l.l_quantity - s.mu, 4)) / power(sum(power(l.l_quantity - s.mu, 2)), 2) - 3, 6) AS qty_kurt
       FROM lineitem l JOIN s ON l.l_returnflag = s.l_returnflag GROUP BY l.l_returnflag""",
)
def q_agg_moments(spark, d):
    out = agg_ops.aggregate(
        T(spark, d, "lineitem"),
        ["l_returnflag"],
        [{"column": "l_quantity", "agg": "skewness", "alias": "qty_skew"}, {"column": "l_quantity", "agg": "kurtosis", "alias": "qty_kurt"}],
    )
    return out.withColumns({"qty_skew": F.round("qty_skew", 6), "qty_kurt": F.round("qty_kurt", 6)})


@register(
    "agg_product",
    "SELECT l_orderkey, product(l_linenumber) AS line_product, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey",
)
def q_agg_product(spark, d):
    return agg_ops.aggregate(
        T(spark, d, "lineitem"),
        ["l_orderkey"],
        [{"column": "l_linenumber", "agg": "product", "alias": "line_product"}, {"column": "l_linenumber", "agg": "len", "alias": "n_lines"}],
    )


@register(
    "agg_multi",
    """SELECT nation, round(sum(balance), 2) AS total_balance, count(key) AS n_accounts, max(balance) AS max_balance
       FROM (SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance FROM customer
             UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier) u GROUP BY nation""",
)
def q_agg_multi(spark, d):
    c = T(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = T(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    out = agg_ops.aggregate_multi(
        [c, s],
        "union_all",
        ["nation"],
        [
            {"column": "balance", "agg": "sum", "alias": "total_balance"},
            {"column": "key", "agg": "count", "alias": "n_accounts"},
            {"column": "balance", "agg": "max", "alias": "max_balance"},
        ],
    )
    return out.withColumn("total_balance", F.round("total_balance", 2))


# ------------------------------------------------------------------ joins


def _join_sides(spark, d):
    left = T(spark, d, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").alias("amount")
    )
    right = T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("amount"))
    return left, right


_JOIN_CTE = with_cte(
    "l AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal AS amount FROM customer)",
    "r AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS amount FROM orders)",
)


@register(
    "join_inner",
    _JOIN_CTE
    + "SELECT l.*, r.o_orderkey, r.o_orderstatus, r.amount AS amount_right FROM l JOIN r ON l.c_custkey = r.o_custkey",
)
def q_join_inner(spark, d):
    l, r = _join_sides(spark, d)
    return joins.merge_join(l, r, [{"left": "c_custkey", "right": "o_custkey"}], "inner")


@register(
    "join_left",
    _JOIN_CTE
    + "SELECT l.*, r.o_orderkey, r.o_orderstatus, r.amount AS amount_right FROM l LEFT JOIN r ON l.c_custkey = r.o_custkey",
)
def q_join_left(spark, d):
    l, r = _join_sides(spark, d)
    return joins.merge_join(l, r, [{"left": "c_custkey", "right": "o_custkey"}], "left")


@register(
    "join_right",
    _JOIN_CTE
    + """SELECT l.c_name, l.c_mktsegment, l.amount, r.o_orderkey, r.o_custkey, r.o_orderstatus, r.amount AS amount_right
         FROM l RIGHT JOIN r ON l.c_custkey = r.o_custkey""",
)
def q_join_right(spark, d):
    l, r = _join_sides(spark, d)
    return joins.merge_join(l, r, [{"left": "c_custkey", "right": "o_custkey"}], "right")


@register(
    "join_full",
    _JOIN_CTE
    + """SELECT l.*, r.o_orderkey, r.o_custkey, r.o_orderstatus, r.amount AS amount_right
         FROM l FULL JOIN r ON l.c_custkey = r.o_custkey""",
)
def q_join_full(spark, d):
    l, r = _join_sides(spark, d)
    return joins.merge_join(l, r, [{"left": "c_custkey", "right": "o_custkey"}], "outer")


@register(
    "join_semi",
    "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
)
def q_join_semi(spark, d):
    return joins.merge_join(T(spark, d, "customer"), T(spark, d, "orders"), [{"left": "c_custkey", "right": "o_custkey"}], "semi")


@register(
    "anti_join",
    "SELECT * FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
)
def q_anti_join(spark, d):
    return joins.anti_join(T(spark, d, "customer"), T(spark, d, "orders"), [{"left": "c_custkey", "right": "o_custkey"}])


@register(
    "anti_join_flag",
    """SELECT c.*, NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) AS no_order
       FROM customer c""",
)
def q_anti_join_flag(spark, d):
    return joins.anti_join(
        T(spark, d, "customer"), T(spark, d, "orders"), [{"left": "c_custkey", "right": "o_custkey"}], flag="no_order"
    )


# ------------------------------------------------------------------ as-of joins

_ASOF_CTE = with_cte(
    "p AS (SELECT * FROM events WHERE event_type = 'purchase')",
    "v AS (SELECT * FROM events WHERE event_type = 'view')",
)
_ASOF_RIGHT = ["event_id", "ts", "event_type", "value", "props"]


def _asof_select(gap_ok: str) -> str:
    cols = ", ".join(f"CASE WHEN {gap_ok} THEN v.{c} END AS {c}_right" for c in _ASOF_RIGHT)
    return f"SELECT p.*, {cols}"


def _asof(spark, d, strategy):
    ev = T(spark, d, "events")
    purchases = ev.filter(F.col("event_type") == "purchase")
    views = ev.filter(F.col("event_type") == "view")
    return joins.asof_join(purchases, views, "ts", by="user_id", strategy=strategy, tolerance="1d")


@register(
    "asof_backward",
    _ASOF_CTE
    + _asof_select("p.ts - v.ts <= INTERVAL 1 DAY")
    + " FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts",
)
def q_asof_backward(spark, d):
    return _asof(spark, d, "backward")


@register(
    "asof_forward",
    _ASOF_CTE
    + _asof_select("v.ts - p.ts <= INTERVAL 1 DAY")
    + " FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.ts",
)
def q_asof_forward(spark, d):
    return _asof(spark, d, "forward")


@register(
    "asof_nearest",
    _ASOF_CTE.rstrip("\n")
    + """,
b AS (SELECT p.event_id AS pid, v.event_id AS vid, p.ts - v.ts AS gap FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts),
f AS (SELECT p.event_id AS pid, v.event_id AS vid, v.ts - p.ts AS gap FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.ts),
c AS (SELECT b.pid,
             CASE WHEN f.vid IS NULL OR (b.vid IS NOT NULL AND b.gap <= f.gap) THEN b.vid ELSE f.vid END AS vid,
             CASE WHEN f.vid IS NULL OR (b.vid IS NOT NULL AND b.gap <= f.gap) THEN b.gap ELSE f.gap END AS gap
      FROM b JOIN f ON b.pid = f.pid)
"""
    + _asof_select("c.gap <= INTERVAL 1 DAY")
    + " FROM p JOIN c ON p.event_id = c.pid LEFT JOIN v ON v.event_id = c.vid",
)
def q_asof_nearest(spark, d):
    return _asof(spark, d, "nearest")


# ------------------------------------------------------------------ set operations


@register(
    "union_all",
    with_cte(V.CUSTOMER_NARROW_SQL, V.SUPPLIER_NARROW_SQL)
    + "SELECT key, name, nation, balance FROM customer_narrow UNION ALL SELECT key, name, nation, balance FROM supplier_narrow",
)
def q_union_all(spark, d):
    c = V.customer_narrow(T(spark, d, "customer")).drop("segment")
    s = V.supplier_narrow(T(spark, d, "supplier"))
    return setops.union([c, s], "union_all")


@register(
    "union_distinct",
    """SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier
       UNION SELECT n_nationkey FROM nation""",
)
def q_union_distinct(spark, d):
    parts = [
        T(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")),
        T(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey")),
        T(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey")),
    ]
    return setops.union(parts, "union")


@register(
    "union_align",
    with_cte(V.CUSTOMER_NARROW_SQL, V.SUPPLIER_NARROW_SQL)
    + "SELECT * FROM customer_narrow UNION ALL SELECT key, name, nation, balance, NULL AS segment FROM supplier_narrow",
)
def q_union_align(spark, d):
    return setops.union([V.customer_narrow(T(spark, d, "customer")), V.supplier_narrow(T(spark, d, "supplier"))], "union_all", align_schema=True)


# ------------------------------------------------------------------ hash / convert / mapping


@register(
    "row_hash",
    with_cte(V.ORDERS_TGT_SQL)
    + """SELECT *, sha256(concat_ws('|', coalesce(CAST(o_orderkey AS VARCHAR), ''), coalesce(o_orderstatus, ''),
                 coalesce(o_orderpriority, ''), coalesce(CAST(o_totalprice AS VARCHAR), ''),
                 coalesce(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f'), ''))) AS row_hash
         FROM orders_tgt""",
)
def q_row_hash(spark, d):
    return rows.row_hash(
        V.orders_tgt(T(spark, d, "orders")), ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"], "row_hash"
    )


@register(
    "format_convert_strict",
    with_cte(V.ORDERS_TEXT_SQL)
    + "SELECT o_orderkey, CAST(key_text AS BIGINT) AS key_text, price_text, strptime(date_text, '%d/%m/%Y')::DATE AS date_text, ts_text FROM orders_text",
)
def q_convert_strict(spark, d):
    return rows.format_convert(
        V.orders_text(T(spark, d, "orders")),
        [{"name": "key_text", "type": "integer"}, {"name": "date_text", "type": "date", "format": "%d/%m/%Y"}],
    )


@register(
    "format_convert_lenient",
    with_cte(V.ORDERS_TEXT_SQL)
    + "SELECT o_orderkey, key_text, TRY_CAST(price_text AS DOUBLE) AS price_text, date_text, ts_text FROM orders_text",
)
def q_convert_lenient(spark, d):
    return rows.format_convert(V.orders_text(T(spark, d, "orders")), [{"name": "price_text", "type": "float", "strict": False}])


@register(
    "format_parse_date",
    with_cte(V.ORDERS_TEXT_SQL)
    + "SELECT o_orderkey, key_text, price_text, try_strptime(date_text, '%d/%m/%Y')::DATE AS date_text, ts_text FROM orders_text",
)
def q_parse_date(spark, d):
    return rows.format_convert(
        V.orders_text(T(spark, d, "orders")), [{"name": "date_text", "type": "date", "format": "%d/%m/%Y", "strict": False}]
    )


@register(
    "format_parse_datetime",
    with_cte(V.ORDERS_TEXT_SQL)
    + "SELECT o_orderkey, key_text, price_text, date_text, strptime(ts_text, '%d/%m/%Y %H:%M:%S') AS ts_text FROM orders_text",
)
def q_parse_datetime(spark, d):
    return rows.format_convert(
        V.orders_text(T(spark, d, "orders")), [{"name": "ts_text", "type": "datetime", "format": "%d/%m/%Y %H:%M:%S"}]
    )


@register(
    "format_flag",
    with_cte(V.ORDERS_TEXT_SQL) + "SELECT *, TRY_CAST(price_text AS DOUBLE) AS price_num FROM orders_text",
)
def q_format_flag(spark, d):
    return rows.format_convert(V.orders_text(T(spark, d, "orders")), [{"name": "price_text", "type": "float", "strict": False}], flag="price_num")


_MAPPINGS = [
    {"target_column": "customer_id", "source_column": "c_custkey", "nullable": False},
    {"target_column": "full_name", "operation": {"type": "concat", "columns": ["c_name", "c_mktsegment"], "separator": " "}},
    {"target_column": "bal_plus", "operation": {"type": "add", "columns": ["c_acctbal", "c_nationkey"]}},
    {"target_column": "bal_minus", "operation": {"type": "subtract", "columns": ["c_acctbal", "c_nationkey"]}},
    {"target_column": "bal_times", "operation": {"type": "multiply", "columns": ["c_acctbal", "c_nationkey"]}},
    {"target_column": "bal_ratio", "operation": {"type": "divide", "columns": ["c_acctbal", "c_nationkey"]}},
    {"target_column": "name_upper", "operation": {"type": "upper", "columns": ["c_name"]}},
    {"target_column": "segment_lower", "operation": {"type": "lower", "columns": ["c_mktsegment"]}},
    {"target_column": "name_trim", "operation": {"type": "trim", "columns": ["c_name"]}},
    {"target_column": "nation_text", "operation": {"type": "cast", "columns": ["c_nationkey"], "data_type": "string"}},
    {"target_column": "load_source", "literal": "WAREHOUSE"},
]


@register(
    "map_target",
    r"""SELECT c_custkey AS customer_id, c_name || ' ' || c_mktsegment AS full_name,
              c_acctbal + c_nationkey AS bal_plus, c_acctbal - c_nationkey AS bal_minus, c_acctbal * c_nationkey AS bal_times,
              CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal / c_nationkey END AS bal_ratio,
              upper(c_name) AS name_upper, lower(c_mktsegment) AS segment_lower,
              regexp_replace(c_name, '^\s+|\s+$', '', 'g') AS name_trim, CAST(c_nationkey AS VARCHAR) AS nation_text,
              'WAREHOUSE' AS load_source
       FROM customer""",
)
def q_map_target(spark, d):
    return mapping.map_target(T(spark, d, "customer"), _MAPPINGS)


@register(
    "map_trim_cast",
    with_cte(V.ORDERS_TEXT_SQL)
    + r"""SELECT o_orderkey AS order_id, regexp_replace(E' \t' || key_text || E'  \n', '^\s+|\s+$', '', 'g') AS trimmed,
              CAST(o_orderkey AS VARCHAR) AS as_string, CAST(key_text AS BIGINT) AS as_integer, CAST(key_text AS DOUBLE) AS as_float,
              o_orderkey % 2 <> 0 AS as_boolean, CAST(ts AS DATE) AS as_date, CAST(ts AS TIMESTAMP) AS as_datetime
       FROM (SELECT *, strftime(strptime(ts_text, '%d/%m/%Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts FROM orders_text)""",
)
def q_map_trim_cast(spark, d):
    """Trim of text with outer white space, and casts to all six types."""
    text = V.orders_text(T(spark, d, "orders"))
    text = text.select(
        "o_orderkey", "key_text", F.concat(F.lit(" \t"), "key_text", F.lit("  \n")).alias("padded"), (F.col("o_orderkey") % 2).alias("odd"),
        F.date_format(F.to_timestamp("ts_text", "dd/MM/yyyy HH:mm:ss"), "yyyy-MM-dd HH:mm:ss").alias("ts"),
    )
    cast = lambda target, column, kind: {"target_column": target, "operation": {"type": "cast", "columns": [column], "data_type": kind}}
    return mapping.map_target(text, [
        {"target_column": "order_id", "source_column": "o_orderkey"},
        {"target_column": "trimmed", "operation": {"type": "trim", "columns": ["padded"]}},
        cast("as_string", "o_orderkey", "string"), cast("as_integer", "key_text", "integer"), cast("as_float", "key_text", "float"),
        cast("as_boolean", "odd", "boolean"), cast("as_date", "ts", "date"), cast("as_datetime", "ts", "datetime"),
    ])


@register(
    "map_coalesce",
    with_cte(V.ORDERS_TGT_SQL) + "SELECT o_orderkey AS order_id, coalesce(o_orderstatus, o_orderpriority) AS status_or_priority FROM orders_tgt",
)
def q_map_coalesce(spark, d):
    return mapping.map_target(
        V.orders_tgt(T(spark, d, "orders")),
        [
            {"target_column": "order_id", "source_column": "o_orderkey", "nullable": False},
            {"target_column": "status_or_priority", "operation": {"type": "coalesce", "columns": ["o_orderstatus", "o_orderpriority"]}},
        ],
    )


# ------------------------------------------------------------------ data quality


@register("schema_flag", "SELECT *, 'MISSING:n_comment' AS schema_check FROM nation")
def q_schema_flag(spark, d):
    return quality.schema_validate(
        T(spark, d, "nation"), {"n_nationkey": "integer", "n_name": "string", "n_comment": "string"}, flag="schema_check"
    )


_EXC_CTE = with_cte(V.CUSTOMER_NARROW_SQL, V.SUPPLIER_NARROW_SQL) + ""
_EXC_UNION = "(SELECT * FROM customer_narrow UNION ALL SELECT key, name, nation, balance, NULL AS segment FROM supplier_narrow) u"


def _exc_inputs(spark, d):
    return [V.customer_narrow(T(spark, d, "customer")), V.supplier_narrow(T(spark, d, "supplier"))]


@register("exceptions", _EXC_CTE + f"SELECT * FROM {_EXC_UNION} WHERE balance < 0")
def q_exceptions(spark, d):
    return quality.exceptions(_exc_inputs(spark, d), {"column": "balance", "op": "lt", "value": 0})


@register("exceptions_rest", _EXC_CTE + f"SELECT * FROM {_EXC_UNION} WHERE NOT (balance < 0)")
def q_exceptions_rest(spark, d):
    return quality.exceptions(_exc_inputs(spark, d), {"column": "balance", "op": "lt", "value": 0}, "valid_only")


@register("exceptions_flag", _EXC_CTE + f"SELECT *, balance < 0 AS is_exception FROM {_EXC_UNION}")
def q_exceptions_flag(spark, d):
    return quality.exceptions(_exc_inputs(spark, d), {"column": "balance", "op": "lt", "value": 0}, flag="is_exception")


def _with_error(spark, d):
    o = V.orders_tgt(T(spark, d, "orders"))
    return o.withColumn("error", F.when(F.col("o_orderstatus").isNull(), F.lit("NULL_STATUS")))


_ERR_SQL = with_cte(V.ORDERS_TGT_SQL) + "SELECT *, CASE WHEN o_orderstatus IS NULL THEN 'NULL_STATUS' END AS error FROM orders_tgt"


@register("quarantine_valid", f"SELECT * FROM ({_ERR_SQL}) e WHERE error IS NULL OR error IN ('', 'OK')")
def q_quarantine_valid(spark, d):
    return quality.quarantine(_with_error(spark, d), "error")[0]


@register("quarantine_rejected", f"SELECT * FROM ({_ERR_SQL}) e WHERE error IS NOT NULL AND error NOT IN ('', 'OK')")
def q_quarantine_rejected(spark, d):
    return quality.quarantine(_with_error(spark, d), "error")[1]


_DRIFT_SCHEMA = {"c_custkey": "integer", "c_name": "string", "c_acctbal": "float", "c_phone": "string"}


@register("drift_add", "SELECT *, 'n/a' AS c_phone FROM customer")
def q_drift_add(spark, d):
    return quality.handle_drift(T(spark, d, "customer"), "add_missing_columns", _DRIFT_SCHEMA, "n/a")


@register("drift_drop", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def q_drift_drop(spark, d):
    return quality.handle_drift(T(spark, d, "customer"), "drop_extra_columns", _DRIFT_SCHEMA)


# ------------------------------------------------------------------ comparisons

_ORD_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _cmp_sql(suffix: str, labels: tuple[str, str, str, str], status: str, tolerance: float | None) -> str:
    right = ", ".join(f"t.{c} AS {c}{suffix}" for c in _ORD_COLS)
    left = ", ".join(f"s.{c}" for c in _ORD_COLS)
    if tolerance:
        price = (
            f"((s.o_totalprice IS NULL) <> (t.o_totalprice IS NULL) OR coalesce(abs(s.o_totalprice - t.o_totalprice) > {tolerance}, false))"
        )
    else:
        price = "(s.o_totalprice IS DISTINCT FROM t.o_totalprice)"
    mism = f"(s.o_orderstatus IS DISTINCT FROM t.o_orderstatus) OR {price}"
    a, b, ch, same = labels
    return (
        with_cte(V.ORDERS_TGT_SQL)
        + f"""SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, {left}, {right},
       CASE WHEN t.o_orderkey IS NULL THEN '{a}' WHEN s.o_orderkey IS NULL THEN '{b}'
            WHEN {mism} THEN '{ch}' ELSE '{same}' END AS {status}
       FROM orders s FULL JOIN orders_tgt t ON s.o_orderkey = t.o_orderkey"""
    )


def _cmp_inputs(spark, d):
    o = T(spark, d, "orders")
    return o, V.orders_tgt(o)


@register("reconcile", _cmp_sql("_tgt", compare.RECON_LABELS, "recon_status", None))
def q_reconcile(spark, d):
    s, t = _cmp_inputs(spark, d)
    return compare.reconcile(s, t, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@register(
    "reconcile_changes",
    f"SELECT * FROM ({_cmp_sql('_tgt', compare.RECON_LABELS, 'recon_status', None)}) x WHERE recon_status <> 'MATCHED'",
)
def q_reconcile_changes(spark, d):
    s, t = _cmp_inputs(spark, d)
    return compare.reconcile(s, t, ["o_orderkey"], ["o_orderstatus", "o_totalprice"], only_changes=True)


@register("reconcile_tolerance", _cmp_sql("_tgt", compare.RECON_LABELS, "recon_status", 0.5))
def q_reconcile_tol(spark, d):
    s, t = _cmp_inputs(spark, d)
    return compare.reconcile(s, t, ["o_orderkey"], ["o_orderstatus", "o_totalprice"], 0.5)


@register("reconcile_tolerance_wide", _cmp_sql("_tgt", compare.RECON_LABELS, "price_check", 2.0))
def q_reconcile_tol2(spark, d):
    s, t = _cmp_inputs(spark, d)
    return compare.reconcile(s, t, ["o_orderkey"], ["o_orderstatus", "o_totalprice"], 2.0, status_column="price_check")


@register("delta", _cmp_sql("_new", compare.DELTA_LABELS, "change_type", None))
def q_delta(spark, d):
    s, t = _cmp_inputs(spark, d)
    return compare.delta(s, t, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@register("snapshot_diff", _cmp_sql("_d2", compare.SNAPSHOT_LABELS, "change_status", None))
def q_snapshot(spark, d):
    s, t = _cmp_inputs(spark, d)
    return compare.snapshot_diff(s, t, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@register(
    "cross_validate",
    with_cte(V.ORDERS_TGT_SQL)
    + f"""SELECT s.*, {", ".join(f"t.{c} AS {c}_right" for c in _ORD_COLS)},
       CASE WHEN coalesce(abs(s.o_totalprice - t.o_totalprice) <= 0.01 AND s.o_orderstatus = t.o_orderstatus, false)
            THEN 'PASS' ELSE 'FAIL' END AS validation_status
       FROM orders s JOIN orders_tgt t ON s.o_orderkey = t.o_orderkey""",
)
def q_cross_validate(spark, d):
    s, t = _cmp_inputs(spark, d)
    rules = [
        {"left_column": "o_totalprice", "right_column": "o_totalprice_right", "op": "eq", "tolerance": 0.01},
        {"left_column": "o_orderstatus", "right_column": "o_orderstatus_right", "op": "eq"},
    ]
    return compare.cross_validate(s, t, ["o_orderkey"], rules)


@register(
    "cross_validate_ops",
    with_cte(V.ORDERS_TGT_SQL)
    + f"""SELECT s.*, {", ".join(f"t.{c} AS {c}_right" for c in _ORD_COLS)},
       CASE WHEN coalesce(abs(s.o_totalprice - t.o_totalprice) > 0.5 AND s.o_totalprice < t.o_totalprice
                 AND s.o_custkey <= t.o_custkey AND s.o_orderkey > t.o_custkey AND s.o_orderkey >= s.o_custkey
                 AND s.o_orderstatus = t.o_orderstatus, false)
            THEN 'PASS' ELSE 'FAIL' END AS validation_status
       FROM orders s JOIN orders_tgt t ON s.o_orderkey = t.o_orderkey""",
)
def q_cross_validate_ops(spark, d):
    """Rules of all six kinds, one with a tolerance."""
    s, t = _cmp_inputs(spark, d)
    rules = [
        {"left_column": "o_totalprice", "right_column": "o_totalprice_right", "op": "neq", "tolerance": 0.5},
        {"left_column": "o_totalprice", "right_column": "o_totalprice_right", "op": "lt"},
        {"left_column": "o_custkey", "right_column": "o_custkey_right", "op": "lte"},
        {"left_column": "o_orderkey", "right_column": "o_custkey_right", "op": "gt"},
        {"left_column": "o_orderkey", "right_column": "o_custkey", "op": "gte"},
        {"left_column": "o_orderstatus", "right_column": "o_orderstatus_right", "op": "eq"},
    ]
    return compare.cross_validate(s, t, ["o_orderkey"], rules)


# ------------------------------------------------------------------ reshape


@register(
    "explode_array",
    with_cte(V.DOC_WORDS_SQL)
    + "SELECT w.doc_id, u.word AS words FROM doc_words w LEFT JOIN LATERAL (SELECT unnest(w.words) AS word) u ON true",
)
def q_explode(spark, d):
    return reshape.explode(V.doc_words(T(spark, d, "documents")), "words")


@register("flatten_json", "SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def q_flatten(spark, d):
    return reshape.flatten(T(spark, d, "events"), "props", prefix="props_")


@register(
    "pivot",
    """SELECT user_id,
              count(event_id) FILTER (WHERE event_type = 'click') AS click,
              count(event_id) FILTER (WHERE event_type = 'error') AS error,
              count(event_id) FILTER (WHERE event_type = 'purchase') AS purchase,
              count(event_id) FILTER (WHERE event_type = 'signup') AS signup,
              count(event_id) FILTER (WHERE event_type = 'view') AS view
       FROM events GROUP BY user_id""",
)
def q_pivot(spark, d):
    out = reshape.pivot(T(spark, d, "events"), ["user_id"], "event_type", ["event_id"], "count")
    return out.select("user_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in out.columns if c != "user_id"])


@register(
    "pivot_multi",
    """SELECT user_id,
              max(value) FILTER (WHERE event_type = 'click') AS click_value,
              max(value) FILTER (WHERE event_type = 'error') AS error_value,
              max(value) FILTER (WHERE event_type = 'purchase') AS purchase_value,
              max(value) FILTER (WHERE event_type = 'signup') AS signup_value,
              max(value) FILTER (WHERE event_type = 'view') AS view_value,
              max(ts) FILTER (WHERE event_type = 'click') AS click_ts,
              max(ts) FILTER (WHERE event_type = 'error') AS error_ts,
              max(ts) FILTER (WHERE event_type = 'purchase') AS purchase_ts,
              max(ts) FILTER (WHERE event_type = 'signup') AS signup_ts,
              max(ts) FILTER (WHERE event_type = 'view') AS view_ts
       FROM events GROUP BY user_id""",
)
def q_pivot_multi(spark, d):
    """Two value columns: new columns are named ``{pivot value}_{value column}``."""
    return reshape.pivot(T(spark, d, "events"), ["user_id"], "event_type", ["value", "ts"], "max")


@register(
    "unpivot",
    """SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part
       UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""",
)
def q_unpivot(spark, d):
    return reshape.unpivot(T(spark, d, "part"), ["p_partkey"], ["p_size", "p_retailprice"])


# ------------------------------------------------------------------ the other given tables


@register(
    "explode_embedding",
    """SELECT e.vec_id, e.label, u.x AS embedding
       FROM embeddings e LEFT JOIN LATERAL (SELECT unnest(e.embedding) AS x) u ON true""",
)
def q_explode_embedding(spark, d):
    return reshape.explode(T(spark, d, "embeddings"), "embedding")


@register(
    "dedup_last_turn",
    "SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC NULLS LAST, text DESC NULLS LAST) = 1",
)
def q_dedup_last_turn(spark, d):
    return rows.deduplicate(T(spark, d, "conversations"), ["conv_id"], "last", order_by=["turn"])


@register(
    "anti_join_unlabeled",
    "SELECT d.* FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def q_anti_unlabeled(spark, d):
    return joins.anti_join(T(spark, d, "documents"), T(spark, d, "labels"), ["doc_id"])


@register(
    "row_hash_pages",
    """SELECT page_id, url, sha256(concat_ws('|', CAST(page_id AS VARCHAR), coalesce(url, ''), coalesce(html, ''))) AS page_hash
       FROM pages""",
)
def q_row_hash_pages(spark, d):
    return rows.row_hash(T(spark, d, "pages"), ["page_id", "url", "html"], "page_hash").drop("html")


@register(
    "agg_documents",
    """SELECT lang, count(doc_id) AS n_docs, sum(n_chars) AS total_chars, round(avg(n_chars), 6) AS mean_chars,
              count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS n_sources,
              max(length(text)) AS longest_text
       FROM documents GROUP BY lang""",
)
def q_agg_documents(spark, d):
    docs = T(spark, d, "documents").withColumn("text_length", F.length("text"))
    out = agg_ops.aggregate(
        docs,
        ["lang"],
        [
            {"column": "doc_id", "agg": "count", "alias": "n_docs"},
            {"column": "n_chars", "agg": "sum", "alias": "total_chars"},
            {"column": "n_chars", "agg": "mean", "alias": "mean_chars"},
            {"column": "source", "agg": "n_unique", "alias": "n_sources"},
            {"column": "text_length", "agg": "max", "alias": "longest_text"},
        ],
    )
    return out.withColumn("mean_chars", F.round("mean_chars", 6))


@register(
    "reconcile_labels",
    """WITH l2 AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels)
       SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.quality, a.toxic, b.quality AS quality_new, b.toxic AS toxic_new,
              CASE WHEN b.doc_id IS NULL THEN 'DELETE' WHEN a.doc_id IS NULL THEN 'INSERT'
                   WHEN a.quality IS DISTINCT FROM b.quality OR a.toxic IS DISTINCT FROM b.toxic THEN 'UPDATE' ELSE 'UNCHANGED' END AS change_type
       FROM labels a FULL JOIN l2 b ON a.doc_id = b.doc_id""",
)
def q_reconcile_labels(spark, d):
    labels = T(spark, d, "labels")
    relabeled = labels.withColumn("quality", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return compare.delta(labels, relabeled, ["doc_id"], ["quality", "toxic"])


# ------------------------------------------------------------------ sinks


@register(
    "merge_upsert",
    with_cte(V.ORDERS_TGT_SQL)
    + "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_tgt) UNION ALL SELECT * FROM orders_tgt",
)
def q_merge_upsert(spark, d):
    path = new_scratch_path(spark, "merge-target")
    orders = T(spark, d, "orders")
    orders.write.parquet(path)
    upsert_path(V.orders_tgt(orders), path, ["o_orderkey"])
    return spark.read.parquet(path)


@register("staging_roundtrip", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def q_staging(spark, d):
    staged = write_staging(T(spark, d, "orders"))
    return rows.filter_rows(staged, {"column": "o_orderstatus", "op": "eq", "value": "F"})


# ------------------------------------------------------------------ streaming


@register(
    "stream_quarantine_rejected",
    "SELECT *, 'PENDING' AS error FROM orders WHERE o_orderstatus = 'P'",
)
def q_stream_quarantine(spark, d):
    """orders replayed as a file stream; each micro-batch split into valid and
    rejected rows (two sinks); the rejected side is read back."""
    base = new_scratch_path(spark, "stream-quarantine")
    src = open_stream(spark, f"{d}/orders.parquet").withColumn(
        "error", F.when(F.col("o_orderstatus") == "P", F.lit("PENDING"))
    )
    q = quarantine_stream(src, "error", f"{base}/valid", f"{base}/rejected", checkpoint=f"{base}/_checkpoint", trigger_once=True)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/rejected").drop("batch_id")


@register(
    "stream_upsert",
    with_cte(V.ORDERS_TGT_SQL)
    + "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_tgt) UNION ALL SELECT * FROM orders_tgt",
)
def q_stream_upsert(spark, d):
    """orders_tgt arrives as a stream and is merged into a copy of orders per
    micro-batch (keyed upsert on o_orderkey)."""
    base = new_scratch_path(spark, "stream-upsert")
    orders = T(spark, d, "orders")
    orders.write.parquet(f"{base}/target")
    V.orders_tgt(orders).write.parquet(f"{base}/inbox")
    q = upsert_stream(open_stream(spark, f"{base}/inbox"), f"{base}/target", ["o_orderkey"], checkpoint=f"{base}/_checkpoint", trigger_once=True)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/target")


@register("stream_dedup_keys", "SELECT DISTINCT user_id, event_type FROM events")
def q_stream_dedup(spark, d):
    """events replayed as a stream, repeated (user, event type) keys dropped
    within a one-hour watermark (state per key, no group held whole); which
    row of a key survives is arbitrary, so the keys are returned."""
    base = new_scratch_path(spark, "stream-dedup")
    deduped = dedup_stream(open_stream(spark, f"{d}/events.parquet"), ["user_id", "event_type"], "ts", "1 hour")
    q = (
        deduped.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/_checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type")


# ------------------------------------------------------------------ whole request (flagship)


def flagship_spec(sf_dir: str, target_path: str) -> dict:
    spec = {
        "version": "1.0",
        "sources": [
            {"name": "customers", "path": f"{sf_dir}/customer.parquet", "columns": ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]},
            {"name": "orders", "path": f"{sf_dir}/orders.parquet", "columns": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]},
        ],
        "actions": [
            {
                "action": "action-filter-dataset",
                "name": "flagged_customers",
                "input": ["customers"],
                "config": {"condition": {"column": "c_mktsegment", "op": "eq", "value": "BUILDING"}},
                "output": {"mode": "flag_column", "target_column": "is_building"},
            },
            {
                "action": "action-merge-join",
                "name": "customer_orders",
                "input": ["flagged_customers", "orders"],
                "config": {"type": "inner", "on": [{"left": "c_custkey", "right": "o_custkey"}]},
            },
            {
                "action": "action-row-hash",
                "name": "final",
                "input": ["customer_orders"],
                "config": {"columns": ["c_custkey", "o_totalprice", "o_orderstatus"], "target_column": "row_hash"},
            },
        ],
        "target": {
            "write_mode": "overwrite",
            "create_if_missing": True,
            "column_mappings": [
                {"target_column": "customer_id", "source_column": "c_custkey", "nullable": False},
                {"target_column": "order_id", "source_column": "o_orderkey", "nullable": False},
                {"target_column": "customer_name", "operation": {"type": "upper", "columns": ["c_name"]}},
                {"target_column": "exposure", "operation": {"type": "add", "columns": ["o_totalprice", "c_acctbal"]}},
                {"target_column": "is_building", "source_column": "is_building"},
                {"target_column": "row_hash", "source_column": "row_hash"},
                {"target_column": "load_source", "literal": "WAREHOUSE"},
            ],
        },
        "options": {"final_dataset": "final"},
    }
    spec["target"]["path"] = target_path
    return spec


FLAGSHIP_SQL = """SELECT c.c_custkey AS customer_id, o.o_orderkey AS order_id, upper(c.c_name) AS customer_name,
       o.o_totalprice + c.c_acctbal AS exposure, c.c_mktsegment = 'BUILDING' AS is_building,
       sha256(concat_ws('|', CAST(c.c_custkey AS VARCHAR), CAST(o.o_totalprice AS VARCHAR),
                        coalesce(o.o_orderstatus, ''))) AS row_hash,
       'WAREHOUSE' AS load_source
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey"""


def flagship_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship request built lazily (no write): filter-flag, join, hash, map."""
    spec = flagship_spec(sf_dir, target_path="unused")
    return build(spark, spec).final


@register("flagship_build", FLAGSHIP_SQL)
def q_flagship_build(spark, d):
    return flagship_frame(spark, d)


@register("flagship_run", FLAGSHIP_SQL)
def q_flagship_run(spark, d):
    path = new_scratch_path(spark, "flagship-target")
    run(spark, flagship_spec(d, path))
    return spark.read.parquet(path)
