"""Derived test datasets, built the same way in Spark and in the oracle SQL.

Each variant is a whole-table transformation of the given tables (nothing
is subset); the key-based rules only decide which rows get changed, so the
comparison steps have differences to find.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import spark_pattern


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_tgt(orders: DataFrame) -> DataFrame:
    """orders as a second system holds them: keys % 97 missing, price + 1 where
    key % 89, status null where key % 83, plus copies of key % 101 rows under
    key + 10,000,000."""
    k = F.col("o_orderkey")
    base = orders.filter(k % 97 != 0).withColumns(
        {
            "o_orderstatus": F.when(k % 83 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")),
            "o_totalprice": F.when(k % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
        }
    )
    extra = orders.filter(k % 101 == 0).withColumn("o_orderkey", k + 10_000_000)
    return base.unionByName(extra)


ORDERS_TGT_SQL = """orders_tgt AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT o_orderkey + 10000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 101 = 0
)"""


def orders_text(orders: DataFrame) -> DataFrame:
    """Text forms of key, price and date; price text is 'bad' where key % 71."""
    k = F.col("o_orderkey")
    return orders.select(
        "o_orderkey",
        k.cast("string").alias("key_text"),
        F.when(k % 71 == 0, F.lit("bad")).otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("price_text"),
        F.date_format("o_orderdate", spark_pattern("%d/%m/%Y")).alias("date_text"),
        F.date_format("o_orderdate", spark_pattern("%d/%m/%Y %H:%M:%S")).alias("ts_text"),
    )


ORDERS_TEXT_SQL = """orders_text AS (
  SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text,
         CASE WHEN o_orderkey % 71 = 0 THEN 'bad' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS price_text,
         strftime(o_orderdate, '%d/%m/%Y') AS date_text,
         strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS ts_text
  FROM orders
)"""


def customer_narrow(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("key"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )


def supplier_narrow(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.col("s_suppkey").alias("key"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"),
    )


CUSTOMER_NARROW_SQL = """customer_narrow AS (
  SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
)"""
SUPPLIER_NARROW_SQL = """supplier_narrow AS (
  SELECT s_suppkey AS key, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier
)"""


def doc_words(documents: DataFrame) -> DataFrame:
    """Every word of each whole document as an array; an empty array where
    doc_id % 50 = 0 and a null one where doc_id % 77 = 0 (cases for explode)."""
    k = F.col("doc_id")
    words = F.split(F.col("text"), r"\s+")
    return documents.select(
        "doc_id",
        F.when(k % 77 == 0, F.lit(None).cast("array<string>"))
        .when(k % 50 == 0, F.array().cast("array<string>"))
        .otherwise(words)
        .alias("words"),
    )


DOC_WORDS_SQL = r"""doc_words AS (
  SELECT doc_id,
         CASE WHEN doc_id % 77 = 0 THEN NULL
              WHEN doc_id % 50 = 0 THEN CAST([] AS VARCHAR[])
              ELSE regexp_split_to_array(text, '\s+') END AS words
  FROM documents
)"""
