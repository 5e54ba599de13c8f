"""Benchmark decontamination with a distributed positional inverted index.

The index holds postings (term, document, position) of the training texts,
for the terms a search can start from: the ``ANCHORS`` rarest words of every
benchmark window by their counts in all training texts.  A search joins the
postings with the windows' terms; a posting at position p of a term at offset
o in an item lies on diagonal p - o, and a window can only occur on a diagonal
where the lists of all its rarest terms meet.  Those candidates are read back
in the text, word by word along the diagonal, which gives the exact phrase
matches.  Proximity matches need the anchors near their places only.

Everything is DataFrame expressions.  Texts are shuffled for candidate
documents only, once each; a document's own hits are merged in a window over
that document.  Small benchmark tables are broadcast within a checked size and
joined by shuffle beyond it.

Defined cases: a null or empty text has no words and is never contaminated; an
item without words has no window; items with a null id hit words but are not
listed; repeated items count once; rows with equal id and text get equal
results, each; other columns are ignored; empty tables work.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import ascii_lower, small, stage

WINDOW = 13
ANCHORS = 2
#: What stands between words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    # regexp_extract_all copies the text at every match
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


@dataclass
class Index:
    """Staged tables: ``docs`` (doc_id, t, text), ``items`` (ik, iw, ids),
    ``windows`` (ik, ws, len, offs), ``postings`` (term, doc_id, t, pos)."""

    docs: DataFrame
    items: DataFrame
    windows: DataFrame
    postings: DataFrame
    window: int


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "t", F.posexplode(words(F.col("text"))).alias("pos", "term"))


def build_index(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    anchors: int = ANCHORS,
) -> Index:
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("t", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("iw")).where("size(iw) > 0")
    items = items.groupBy("iw").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    items = stage(items.withColumn("ik", F.xxhash64(F.array_join("iw", " "))), "bench-items")
    starts = items.select(
        "ik", "iw", F.least(F.size("iw"), F.lit(window)).alias("len"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.size("iw") - window, F.lit(0)))).alias("ws"),
    )
    terms = starts.select("ik", "ws", "len", F.posexplode(F.expr("slice(iw, ws + 1, len)")).alias("o", "term"))
    terms = terms.select("ik", "ws", "len", (F.col("ws") + F.col("o")).alias("off"), "term")
    vocabulary = stage(terms.select("term").distinct(), "bench-terms")
    counts = _tokens(docs).join(small(vocabulary), "term").groupBy("term").agg(F.count("*").alias("c"))
    counts = stage(counts, "bench-counts")
    rarest = terms.join(small(counts), "term", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rank = Window.partitionBy("ik", "ws").orderBy("c", "term", "off")
    rarest = rarest.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= anchors)
    windows = rarest.groupBy("ik", "ws", "len").agg(
        F.min("c").alias("least"), F.collect_list(F.struct("off", "term")).alias("anchors")
    ).where("least > 0")
    windows = stage(windows.select("ik", "ws", "len", "anchors"), "bench-windows")
    needed = stage(windows.select(F.explode("anchors.term").alias("term")).distinct(), "bench-anchors")
    postings = _tokens(docs).join(small(needed), "term").select("term", "doc_id", "t", "pos")
    return Index(docs, items, windows, stage(postings, "postings"), window)


def _diagonals(index: Index) -> DataFrame:
    """Postings of anchor terms, shifted to the diagonals of their items."""
    places = index.windows.select("ik", F.explode("anchors").alias("a")).select("ik", "a.off", "a.term").distinct()
    places = stage(places, "anchor-places")
    return index.postings.join(small(places), "term").select(
        "doc_id", "t", "ik", (F.col("pos") - F.col("off")).alias("diag"), "off"
    )


def _anchor_sets(index: Index) -> DataFrame:
    sets = index.windows.groupBy("ik").agg(F.collect_set(F.expr("transform(anchors, a -> a.off)")).alias("need"))
    return stage(sets, "anchor-sets")


def candidates(index: Index) -> DataFrame:
    """Diagonals on which all anchors of some window meet."""
    met = _diagonals(index).groupBy("doc_id", "t", "ik", "diag").agg(F.collect_set("off").alias("offs"))
    met = met.join(small(_anchor_sets(index)), "ik")
    return met.where("exists(need, w -> size(array_except(w, offs)) = 0)").select("doc_id", "t", "ik", "diag")


def phrase_matches(index: Index) -> DataFrame:
    """Exact matches as maximal spans: ``doc_id, t, ik, s, e`` (words s to
    e - 1 of the document are covered by occurrences of the item's windows)."""
    lengths = index.items.select("ik", F.size("iw").alias("n"))
    found = candidates(index).join(small(lengths), "ik")
    found = found.groupBy("doc_id", "t").agg(F.collect_list(F.struct("ik", "diag", "n")).alias("c"))
    found = stage(found, "candidates").withColumnsRenamed({"doc_id": "d", "t": "u"})
    read = index.docs.join(small(found), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")))
    read = read.select("doc_id", "t", "c", words(F.col("text")).alias("dw"))
    read = read.select("doc_id", "t", F.explode(F.expr(
        "transform(c, x -> struct(x.ik AS ik, x.diag AS diag, slice(dw, greatest(x.diag, 0) + 1, "
        "greatest(least(x.n - greatest(-x.diag, 0), size(dw) - greatest(x.diag, 0)), 0)) AS part))"
    )).alias("x")).select("doc_id", "t", "x.ik", "x.diag", "x.part")
    read = read.join(small(index.items.select("ik", "iw")), "ik")
    same = "array_join(zip_with(slice(iw, greatest(-diag, 0) + 1, size(part)), part, (a, b) -> if(a = b, '1', '0')), '')"
    read = read.select("doc_id", "t", "ik", "diag", F.least(F.size("iw"), F.lit(index.window)).alias("len"), F.expr(same).alias("m"))
    runs = (
        "filter(if(length(m) >= len, sequence(1, length(m) - len + 1), cast(array() as array<int>)), i -> "
        "substring(m, i, len) = repeat('1', len) AND (i = 1 OR substring(m, i - 1, 1) = '0'))"
    )
    read = read.select("doc_id", "t", "ik", "diag", "m", F.explode(F.expr(runs)).alias("i"))
    start = F.greatest(F.col("diag"), F.lit(0)) + F.col("i") - 1
    stop = F.expr("if(locate('0', m, i) = 0, length(m) + 1, locate('0', m, i))")
    return read.select("doc_id", "t", "ik", start.alias("s"), (start + stop - F.col("i")).alias("e")).distinct()


def proximity_matches(index: Index, slop: int) -> DataFrame:
    """Windows whose words all occur within ``slop`` words of their places:
    ``doc_id, t, ik, ws, near`` (diagonal of the anchors rounded down to
    slop + 1 words).  Where the anchors do, the text is read back."""
    width = slop + 1
    met = _diagonals(index).withColumn("cell", F.floor(F.col("diag") / width))
    # a spread of at most slop lies within two neighbouring cells
    met = met.select("doc_id", "t", "ik", "off", "diag", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"))
    met = met.groupBy("doc_id", "t", "ik", "cell").agg(F.collect_set(F.struct("off", "diag")).alias("seen"))
    wins = index.windows.select("ik", "ws", F.expr("transform(anchors, a -> a.off)").alias("need"))
    met = met.join(small(stage(wins, "anchor-windows")), "ik")
    close = (
        f"exists(seen, x -> forall(need, o -> exists(seen, y -> y.off = o AND y.diag >= x.diag AND y.diag <= x.diag + {slop})))"
    )
    met = met.where(close).select("doc_id", "t", "ik", "ws", (F.col("cell") * width).cast("int").alias("near")).distinct()
    met = met.join(small(stage(index.windows.select("ik", "ws", "len"), "window-lengths")), ["ik", "ws"])
    found = met.groupBy("doc_id", "t").agg(F.collect_list(F.struct("ik", "ws", "near", "len")).alias("c"))
    found = stage(found, "near-candidates").withColumnsRenamed({"doc_id": "d", "t": "u"})
    read = index.docs.join(small(found), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")))
    read = read.select("doc_id", "t", "c", words(F.col("text")).alias("dw"))
    # the words at least diagonals near - slop to near + 2 * width - 1
    read = read.select("doc_id", "t", F.explode(F.expr(
        f"transform(c, x -> named_struct('ik', x.ik, 'ws', x.ws, 'near', x.near, 'len', x.len, 'p', greatest(x.near - {slop} + x.ws, 0), "
        f"'part', slice(dw, greatest(x.near - {slop} + x.ws, 0) + 1, "
        f"greatest(x.near + x.ws + x.len + {2 * width + slop} - greatest(x.near - {slop} + x.ws, 0), 0))))"
    )).alias("x")).select("doc_id", "t", "x.*")
    read = read.join(small(index.items.select("ik", "iw")), "ik")
    at = "d + ws + k - p"  # place in the part
    whole = (
        f"exists(sequence(near - {slop}, near + {2 * width - 1}), d -> forall(sequence(0, len - 1), k -> "
        f"array_contains(slice(part, greatest({at}, 0) + 1, greatest({at} + {width} - greatest({at}, 0), 0)), iw[ws + k])))"
    )
    return read.where(whole).select("doc_id", "t", "ik", "ws", F.col("near").cast("long").alias("near")).distinct()


def contamination(index: Index, least_share: int = 20) -> DataFrame:
    """One row per document row: ``doc_id, t, n_words, n_hit, items`` (sorted
    ids) and ``contaminated`` (hit words times ``least_share`` >= words)."""
    hits = stage(phrase_matches(index), "hits")
    order = Window.partitionBy("doc_id", "t").orderBy("s", "e")
    before = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hits.groupBy("doc_id", "t", "s").agg(F.max("e").alias("e"))
    n_hit = spans.select("doc_id", "t", F.greatest(F.lit(0), F.col("e") - F.greatest("s", before)).alias("w"))
    n_hit = n_hit.groupBy("doc_id", "t").agg(F.sum("w").alias("n_hit"))
    named = hits.join(small(index.items.select("ik", "ids")), "ik").select("doc_id", "t", F.explode("ids").alias("id"))
    named = named.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("id")).alias("items"))
    same = lambda r: F.col("doc_id").eqNullSafe(r.d) & F.col("t").eqNullSafe(r.u)
    n_hit, named = (x.withColumnsRenamed({"doc_id": "d", "t": "u"}) for x in (n_hit, named))
    rows = index.docs.select("doc_id", "t", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.join(n_hit, same(n_hit), "left").drop("d", "u").join(named, same(named), "left").drop("d", "u")
    rows = rows.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    rows = rows.withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least_share >= F.col("n_words")))
