"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgeo.llm.common import discard, saved


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in a link
    (columns a and b; any type with an order).  Large-star and small-star
    steps alternate until nothing changes; each needs the smallest neighbour
    of a node only, which is summed up before the shuffle, so a node with very
    many links costs a task one row of it."""
    edges = saved(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        last, edges, before = edges, saved(small, "links"), state
        discard(last)
        state = _state(edges)
        if state == before:
            roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Two numbers that change whenever the links do."""
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())
