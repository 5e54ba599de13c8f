"""Trie of conversation prefixes by the Euler-tour technique.

Conversations that start alike share the nodes of a trie.  A prefix is named
by the exclusive or of a hash of each of its turns with its place (two words
of 60 bits from SHA-256), a running total along the conversation, so neither a
long conversation nor a common prefix is gathered anywhere.

For the sums over subtrees every node gets an enter and an exit arc.  The arcs
form one list, the tour: after a node's enter arc comes that of its first
child, or its exit arc; after an exit arc the enter arc of the next sibling,
or the parent's exit arc.  Children are ordered by their least member and
numbered by a running total, so their neighbours are found by equality.  The
list is ranked by contraction: in each round the arcs whose hash is a local
minimum along the list (a third, no two adjacent) leave it, and tell their
neighbours; when at most ``SOLVE_ARCS`` remain they are walked through in one
task, and the arcs that left get their places back in reverse rounds.  Running
totals of leaves and savings over the places then give a subtree's sum as the
difference between its exit and its enter arc.

All tables are staged in the shared folder between steps.  The hash of a node's
members is one SHA-256 over their ordered ids: pieces of ``PIECE_IDS`` ids are
made in parallel and streamed through the hash.

Defined cases: rows with a null conversation id take no part; null turns come
first, and turns of equal number in the order of a hash of role and text; null
role or text is empty; repeated rows are turns of their own; ids below zero
belong to the multiple of 20 next towards zero; other columns are ignored; an
empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import small, stage
from tablewright.operators.running import running

FAMILY = 20
HEADS = 4
WORD = r"[^\x20\x09-\x0D]+"
SOLVE_ARCS = 16_384
PIECE_IDS = 4096

_KEY = ["depth", "k1", "k2"]
_END = -1


def _two_words(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 17)]


def numbered_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, at`` (place in the conversation, from 0), ``digest, words``."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    rows = running(rows, ["conv"], ["turn", "digest", "row"], {"at": ("sum", F.lit(1).cast("long"))})
    return stage(rows.select("conv", (F.col("at") - 1).alias("at"), "digest", "words"), "numbered-turns")


def own_head(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame, head: Callable[[Column], Column] = own_head, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first ``head`` turns of their family's first one
    in place of their own: turns (``conv, at, digest, words, total``) and
    conversations (``conv, total``)."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = stage(convs.select("conv", "n", head(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % family).alias("first")), "convs")
    firsts = stage(convs.where("conv = first").select("first", F.col("n").alias("n_first")), "family-firsts")
    convs = convs.join(small(firsts), "first", "left").withColumn("taken", F.least("h", F.coalesce("n_first", F.lit(0))))
    convs = stage(convs.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt-convs")
    own = turns.join(small(convs.select("conv", "h", "taken", "total")), "conv").where("at >= h")
    own = own.select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "digest", "words", "total")
    heads = stage(turns.where((F.col("conv") % family == 0) & (F.col("at") < HEADS - 1)).withColumnRenamed("conv", "first"), "heads")
    lead = convs.where("taken > 0").select("conv", "first", "taken", "total").join(small(heads), "first").where("at < taken")
    return own.union(lead.select("conv", "at", "digest", "words", "total")), convs.select("conv", "total")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv, depth, k1, k2`` (name of the first ``depth`` turns), ``p1, p2``
    (of one turn less), ``words, total``."""
    x1, x2 = _two_words(F.sha2(F.concat(F.col("at").cast("string"), F.lit(":"), "digest").cast("binary"), 256))
    turns = turns.select("conv", "at", "words", "total", x1.alias("x1"), x2.alias("x2"))
    turns = running(turns, ["conv"], ["at"], {"k1": ("xor", F.col("x1")), "k2": ("xor", F.col("x2"))})
    named = turns.select(
        "conv", (F.col("at") + 1).alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "words", "total",
    )
    return stage(named, "prefixes")


def build_nodes(named: DataFrame, convs: DataFrame) -> DataFrame:
    """``node, depth, k1, k2, conv_id, n_convs, words, parent, parent_conv_id``."""
    zero = F.lit(0).cast("long")
    nodes = named.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.max("words").alias("words")
    )
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("p1"), zero.alias("p2"), zero.alias("words"))
    nodes = nodes.select(root.columns).union(root)
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return stage(nodes.join(small(stage(above, "parents")), ["depth", "p1", "p2"], "left").drop("p1", "p2"), "trie")


def tour(nodes: DataFrame) -> DataFrame:
    """The Euler tour as a doubly linked list: ``arc, next, prev, len``.  A
    node's enter arc is twice its number, its exit arc one more."""
    kids = nodes.where("parent is not null").select("node", "parent", "conv_id")
    kids = running(kids, ["parent"], ["conv_id"], {"nth": ("sum", F.lit(1).cast("long"))})
    kids = stage(kids, "ordered-siblings")
    first = kids.where("nth = 1").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    after = kids.select("parent", (F.col("nth") - 1).alias("nth"), F.col("node").alias("sibling"))
    enter, exit_ = 2 * F.col("node"), 2 * F.col("node") + 1
    down = nodes.select("node").join(first, "node", "left").select(enter.alias("arc"), F.coalesce(2 * F.col("child"), exit_).alias("next"))
    across = kids.join(after, ["parent", "nth"], "left")
    across = across.select(exit_.alias("arc"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("next"))
    last = nodes.where("parent is null").select(exit_.alias("arc"), F.lit(_END).cast("long").alias("next"))
    arcs = stage(down.union(across).union(last), "arcs")
    back = arcs.where(f"next <> {_END}").select(F.col("next").alias("arc"), F.col("arc").alias("prev"))
    arcs = arcs.join(back, "arc", "left").select("arc", "next", F.coalesce("prev", F.lit(_END)).alias("prev"), F.lit(1).cast("long").alias("len"))
    return stage(arcs, "tour")


def _walk(arcs: pd.DataFrame) -> pd.DataFrame:
    """Distance to the end of the list, for a list in one piece."""
    names = arcs["arc"].to_numpy()
    place = pd.Series(np.arange(len(names)), index=names)
    step = place.reindex(arcs["next"]).fillna(len(names)).to_numpy(dtype=np.int64)
    far, step = np.append(arcs["len"].to_numpy(), 0), np.append(step, len(names))
    while (step < len(names)).any():  # each arc jumps twice as far
        far, step = far + far[step], step[step]
    return pd.DataFrame({"arc": names, "far": far[:-1]})


def ranked(arcs: DataFrame, solve_arcs: int | None = None) -> DataFrame:
    """``arc, far``: the length of the list from each arc on, itself included."""
    solve_arcs = SOLVE_ARCS if solve_arcs is None else solve_arcs
    left: list[DataFrame] = []
    n = arcs.count()
    while n > solve_arcs:
        mine, before, behind = (F.xxhash64(F.col(c), F.lit(len(left))) for c in ("arc", "prev", "next"))
        leaves = (F.col("prev") != _END) & (mine < before) & ((F.col("next") == _END) | (mine < behind))
        marked = stage(arcs.withColumn("leaves", leaves), "list")
        gone = marked.where("leaves").drop("leaves")
        left.append(gone.select("arc", "next", "len"))
        none = F.lit(None).cast("long")
        news = marked.where("not leaves").select("arc", "next", "prev", "len", none.alias("next_"), none.alias("prev_"))
        news = news.union(gone.select(F.col("prev"), none, none, "len", F.col("next"), none))
        news = news.union(gone.where(f"next <> {_END}").select("next", none, none, F.lit(0).cast("long"), none, F.col("prev")))
        arcs = news.groupBy("arc").agg(
            F.coalesce(F.max("next_"), F.max("next")).alias("next"), F.coalesce(F.max("prev_"), F.max("prev")).alias("prev"), F.sum("len").alias("len")
        )
        arcs = stage(arcs, "contracted")
        n = arcs.count()
    far = stage(arcs.withColumn("list", F.lit(0)).groupBy("list").applyInPandas(_walk, "arc long, far long"), "ranked")
    for gone in reversed(left):
        behind = far.withColumnsRenamed({"arc": "next", "far": "behind"})
        back = gone.join(behind, "next", "left").select("arc", (F.col("len") + F.coalesce("behind", F.lit(0))).alias("far"))
        far = far.union(stage(back, "ranked"))
    return far


def subtree_sums(nodes: DataFrame, far: DataFrame) -> DataFrame:
    """``node, n_leaves, saved_tokens`` from running totals along the tour.
    ``nodes`` has ``leaves`` and ``saves``, what each node adds itself."""
    arcs = far.select(F.expr("arc div 2").alias("node"), (F.col("arc") % 2).alias("leaving"), (-F.col("far")).alias("place"))
    arcs = arcs.join(nodes.select("node", "leaves", "saves"), "node")
    own = lambda c: F.when(F.col("leaving") == 0, F.col(c)).otherwise(F.lit(0))
    arcs = running(arcs, [], ["place"], {"sum_leaves": ("sum", own("leaves")), "sum_saves": ("sum", own("saves"))})
    at = lambda c: F.max(F.when(F.col("leaving") == 1, F.col(c))) - F.max(F.when(F.col("leaving") == 0, F.col(c)))
    return arcs.groupBy("node").agg(
        (at("sum_leaves") + F.max("leaves")).alias("n_leaves"), (at("sum_saves") + F.max("saves")).alias("saved_tokens")
    )


def _stream_hash(batches):
    """SHA-256 over the pieces of each key, which come in order."""
    key, state = None, None
    done: list[tuple] = []
    for rows in batches:
        for *at, text in zip(*(rows[c] for c in (*_KEY, "piece"))):
            if at != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pd.DataFrame(done, columns=[*_KEY, "ends_sha256"])
        done = []
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=[*_KEY, "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` of the conversations (``conv``) that end
    at a node."""
    ends = running(ends.select(*_KEY, "conv"), _KEY, ["conv"], {"nth": ("sum", F.lit(1).cast("long"))})
    pieces = ends.withColumn("part", F.expr(f"(nth - 1) div {PIECE_IDS}")).groupBy(*_KEY, "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("piece")
    )
    pieces = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "part").select(*_KEY, "piece")
    return pieces.mapInPandas(_stream_hash, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    head: Callable[[Column], Column] = own_head, family: int = FAMILY,
) -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns, convs = rebuilt(numbered_turns(conversations, conv_col, turn_col, role_col, text_col), head, family)
    named = prefixes(turns)
    nodes = build_nodes(named, convs)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saves", (F.col("n_convs") - 1) * F.col("words"))
    nodes = stage(nodes, "trie-nodes")
    if nodes.isEmpty():
        sums = nodes.select("node", F.col("leaves").alias("n_leaves"), F.col("saves").alias("saved_tokens"))
    else:
        sums = subtree_sums(nodes, ranked(tour(nodes)))
    zero = F.lit(0).cast("long")
    ends = named.where("depth = total").select(*_KEY, "conv").union(convs.where("total = 0").select(zero, zero, zero, "conv"))
    out = nodes.join(sums, "node").join(end_hashes(ends), _KEY, "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )
