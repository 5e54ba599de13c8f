"""Registered queries of the corpus operators and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (
    cdc_dedup, decontaminate, html_text, katz, multi_index, norm_buckets, packing, prefix_trie, quality_crf, secrets, simhash,
    suffix_dedup, voronoi_topk,
)
from tablewright.llm.common import remainder, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.to_hex("fp").alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(index).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    kind = lambda k: F.size(F.filter("spans", lambda s: s.startswith(k + ":"))).cast("long")
    base = F.array_join(F.filter("spans", lambda s: ~s.startswith("random:")), ",")
    return found.select(
        "doc_id", kind("assign").alias("n_assign"), kind("access").alias("n_access"), kind("hex").alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"),
    )


def op7_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cdc_dedup.dedup(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_bytes", "n_chunks", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["s"], s["e"])), ",").alias("spans"),
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = katz.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return rows.select(
        "doc_id", F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_crf.fit_sample(docs, labels.where(remainder("doc_id", 5) != 0))
    scored = quality_crf.classify(docs, model)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_decontaminate": op3_decontaminate,
    "op4_topk": op4_topk,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_secrets": op6_secrets,
    "op7_cdc_dedup": op7_cdc_dedup,
    "op8_html_text": op8_html_text,
    "op9_katz": op9_katz,
    "op10_quality": op10_quality,
    "op11_multi_index": op11_multi_index,
    "op12_norm_buckets": op12_norm_buckets,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORDS = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE = {
    "op3_decontaminate": rf"""
WITH items AS (
  SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, least(n, 13) AS l, array_to_string(w[i:i + least(n, 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, greatest(n - 13, 0) + 2)) AS i FROM items)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), lengths AS (SELECT DISTINCT l FROM wins), grams AS (
  SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM docs, lengths)
), hits AS (
  SELECT r, i, g.l, item_id FROM grams g JOIN wins USING (l, win)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5""",
    "op5_suffix_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT r, base + i AS p, md5(substr(part, 2 * i + 1, 400)) AS h FROM (
    SELECT r, base, part, unnest(range(0, len(part) // 2 - 199)) AS i FROM (
      SELECT r, base, substr(x, 2 * base + 1, 2 * (256 + 199)) AS part FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199, 256)) AS base FROM d WHERE len(x) >= 400)
    )
  )
), again AS (
  SELECT r, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), marked AS (
  SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS first FROM again
), span AS (
  SELECT r, min(p) AS s, max(p) + 200 AS e FROM (SELECT r, p, sum(first) OVER (PARTITION BY r ORDER BY p) AS g FROM marked) GROUP BY r, g
), cut AS (
  SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS b FROM span
), kept AS (
  SELECT r, count(*) AS n_spans, sum(e - s) AS n_removed,
    string_agg(substr(x, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) || substr(any_value(x), 2 * max(e) + 1) AS rest
  FROM cut JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', role, text))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT c, list(x ORDER BY i) AS xs, c - c % 20 AS f, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: xor(v >> 1, (v & 1) * 3988292384)))) % 4 AS h
  FROM t GROUP BY c
), seqs AS (
  SELECT n.c, list_concat(coalesce(f.xs, [])[:n.h], n.xs[n.h + 1:]) AS xs FROM n LEFT JOIN n f ON f.c = n.f
), p AS (
  SELECT c, xs[:d] AS k, d, len(xs) = d AS is_end, CASE WHEN d > 0 THEN xs[d].t ELSE '' END AS last
  FROM (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS d FROM seqs)
), node AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c, ',' ORDER BY c) FILTER (is_end), '') AS ends,
    (count(*) - 1) * len(list_filter(regexp_extract_all(any_value(last), '[^\x20\x09-\x0D]+'), lambda x: x <> '')) AS saves
  FROM p GROUP BY k, d
), kids AS (
  SELECT a.k, count(b.k) AS n FROM node a LEFT JOIN node b ON b.d = a.d + 1 AND b.k[:a.d] = a.k GROUP BY a.k
), whole AS (
  SELECT a.k, CAST(sum(CASE WHEN kids.n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(b.saves) AS BIGINT) AS saved_tokens
  FROM node a JOIN node b ON b.k[:a.d] = a.k JOIN kids ON kids.k = b.k GROUP BY a.k
)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, above.conv_id AS parent_conv_id, a.n_convs, kids.n AS n_children, n_leaves, saved_tokens,
  sha256(a.ends) AS ends_sha256
FROM node a JOIN kids USING (k) JOIN whole USING (k) LEFT JOIN node above ON a.d > 0 AND above.k = a.k[:a.d - 1]""",
    "op12_norm_buckets": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), size AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0
), b AS (
  SELECT i, item_id, term, CAST(count(*) AS BIGINT) AS q
  FROM (SELECT row_number() OVER () AS i, item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL
), f AS (
  SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM b) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, size GROUP BY term, docs
), scored AS (
  SELECT i, item_id, r, doc_id,
    CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM b JOIN weight USING (term) JOIN f USING (term), size GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20""",
    "op11_multi_index": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), near AS (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT r, r AS other FROM v UNION SELECT reach.r, near.b FROM reach JOIN near ON reach.other = near.a
), least AS (
  SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.other GROUP BY reach.r
), links AS (SELECT a AS r, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN least USING (r) LEFT JOIN links USING (r)""",
}
