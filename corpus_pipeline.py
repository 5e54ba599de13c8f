"""Corpus pipeline: documents to packed training sequences.

Each stage reads what the one before it kept, from Parquet in the shared
folder, and its decision takes effect in its rows:

1. quality   documents that the line CRF rejects go
2. near_dup  one document (the least id) of each SimHash component stays
3. decontam  documents contaminated with benchmark windows go
4. secrets   secret spans are replaced by ``[secret]``, ``n_chars`` follows
5. pack      the texts are cut into power-of-two sequences

Defined cases are those of the operators; rows with a null id are kept or
judged like others, repeated rows are copies of one document for near_dup.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, packing, quality_crf, secrets, simhash
from tablewright.llm.common import fresh_name, remainder, small, stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = quality_crf.fit_sample(docs, labels.where(remainder("doc_id", 5) != 0))
    return docs.where(quality_crf.quality_column(F.col("text"), model) >= quality_crf.THRESHOLD)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are told apart by a staged number, so repeated and null ids are safe
    row = fresh_name(docs, "row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "near-dup")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = simhash.near_duplicates(rows.select(key.alias("key"), "text"), id_col="key")
    stays = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.row").alias(row))
    return rows.join(stays, row, "left_semi").select(docs.columns)


def decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(docs, table(spark, sf_dir, "benchmark"))
    bad = decontaminate.contamination(index).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
    bad = small(stage(bad.distinct(), "contaminated"))
    same = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_t"])
    return docs.join(bad, same, "left_anti")


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = docs.withColumn("text", secrets.redact(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_dup", near_dup),
    ("decontam", decontam),
    ("secrets", scan_secrets),
    ("pack", pack),
]

#: Neither the CRF nor tokenization can be written in SQL; tests hold each
#: stage against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
