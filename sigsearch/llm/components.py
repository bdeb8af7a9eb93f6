"""Connected components over a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsearch.llm.common import written


def _star(arcs: DataFrame, least: DataFrame, keep) -> DataFrame:
    return arcs.join(least, "u").where(keep).select(
        F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).where("a <> b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link.

    ``links`` holds two long columns ``a`` and ``b``.  In each round the neighbours of a node are hung on the
    smallest of them; the pairs shrink to stars.  Neighbourhoods are aggregated and joined, never collected, and
    every round is a written table, so the loop holds one number per round on the driver.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = written(pairs, name)
    seen = None
    while True:
        # large star: from every node its larger neighbours go to the smallest neighbour (or itself)
        arcs = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(_star(arcs, least, F.col("v") > F.col("u")), name)
        # small star: a node's smaller neighbours and the node itself go to the smallest
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        both = down.unionByName(least.select("u", F.col("u").alias("v")))
        pairs = written(_star(both, least, F.lit(True)), name)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
