"""Connected components of a link table by large-star and small-star steps.

Every step is one aggregation and one join on the node; the links are written
to the shared folder between steps, so an executor lost later costs no
earlier step.  A node's least neighbours are broadcast where the links are few
by their count; beyond that they are staged, so that the join reads two plain
tables and the rows of a giant component's root can be split among tasks.
Nothing but a count and a checksum of the links reaches the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stage


#: Links that a broadcast of all nodes' least neighbours is bounded by.
FEW_LINKS = 200_000


def _star(links: DataFrame, large: bool, few: bool) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    least = F.broadcast(least) if few else stage(least, "star-least")
    joined = both.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n"))
    if large:
        new = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return new.where("a <> b").distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``links`` (a, b): ids of any orderable type.  Returns ``node, root``
    for every node but the roots; the root is the component's least node."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = stage(links, label)
    check = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    before = tuple(links.agg(*check).first())
    while before[0]:
        few = before[0] <= FEW_LINKS
        wide = _star(links, True, few)
        links = stage(_star(wide if few else stage(wide, label), False, few), label)
        after = tuple(links.agg(*check).first())
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
