"""Connected components of a table of links, by alternating large and small stars.

Each round joins every node's links to the smallest node of its neighbourhood and writes the
new links to the shared folder; the number of rounds grows with the logarithm of the longest
path. Nothing is collected but two numbers per round. The smallest neighbours are written
before they are joined, so that adaptive skew handling can cut the rows of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _smallest(links: DataFrame) -> DataFrame:
    return stored(links.groupBy("u").agg(F.min("v").alias("m")), "smallest")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of node and neighbours."""
    both = links.union(links.select("v", "u"))
    nearest = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    nearest = _smallest(links)
    others = links.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(nearest.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for each node that has a link to another; ``root`` is the component's smallest node.

    Links may repeat and stand in either direction; links with a null end and links of a node
    to itself are ignored. No links give no rows.
    """
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = stored(links, "links")
    before = _state(links)
    while before[0]:
        links = stored(_small_star(stored(_large_star(links), "large")), "small")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
