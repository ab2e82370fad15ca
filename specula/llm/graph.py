"""Connected components of links that no one machine needs to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (u, v): the smallest node reachable.

    Alternates large-star and small-star steps: each points the neighbours of a node at the smallest one, with minima that
    are combined before the shuffle and joins that may be split at a node with many links. It ends when the links are
    stars, which a checksum of the written rows tells.
    """
    edges = written(_oriented(links.select("u", "v")), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _oriented(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(_oriented(small), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = edges.groupBy("v").agg(F.lit(0).alias("x")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(roots)


def _oriented(links: DataFrame) -> DataFrame:
    """Distinct links from the larger node to the smaller."""
    return links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
