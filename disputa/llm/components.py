"""Connected components of links, by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputa.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): component is the smallest id that links reach.

    Each round halves paths. Minima are taken in each task before the shuffle and written, so both sides of each join
    are plain shuffles, in which the rows of a hub can be split. Null ends and self-links are ignored; an empty table
    gives an empty result.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges")
    before = None
    while True:
        # Large star: the larger end of an edge moves to the least neighbour of its smaller end, or stays with it.
        below = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("m")), "below")
        large = scratch.keep(edges.join(below.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "large")
        # Small star: all smaller neighbours of a vertex move to the least of them.
        lowest = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lowest")
        small = large.join(lowest.filter("n > 1"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = scratch.keep(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = made.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges, below, large, lowest)
        edges = made
        if tuple(state) == before:
            break
        before = tuple(state)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
