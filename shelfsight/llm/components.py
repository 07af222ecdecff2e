"""Connected components of a table of links, by alternating star steps on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node that can be reached.

    Each round hangs the larger neighbours of a node, then the smaller ones, under the smallest; it ends when the links
    don't change any more, which are then stars. A node with very many links is only ever summed (its minimum) and joined,
    so no task holds its neighbours. Every round is written to the shared folder: an executor lost costs a re-read.
    """
    links = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        # Larger neighbours of a go under the least of a and its neighbours.
        both = links.union(links.select("b", "a"))
        least = _least_neighbour(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = saved(large.distinct(), name)
        # Then a and its smaller neighbours go under the least of these.
        least = _least_neighbour(large)
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        links = saved(small.select("l.a", "l.b").where("a <> b").distinct(), name)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
