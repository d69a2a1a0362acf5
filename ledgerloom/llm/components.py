"""Connected components of a link table by alternating large and small stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Links from which on aggregates are written before they are joined, so that Spark can split a hub's rows over tasks.
LARGE = 1_000_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    No neighbour list is ever gathered: each round takes the smallest neighbour by an aggregate and joins it
    back, so a node with very many links is an ordinary skewed join; from LARGE links on both sides of it are plain
    tables, whose skewed partitions Spark splits. Rounds grow with the logarithm of the longest path; each is
    written to the shared folder.
    """
    star = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    state = _digest(star)
    while state[0]:
        plain = cut if state[0] >= LARGE else lambda df: df
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(star.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = plain(least)
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = plain(large)
        lowest = plain(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(lowest, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        star = cut(small.union(lowest.select("hi", F.col("m").alias("lo"))).distinct())
        now = _digest(star)
        if now == state:
            break
        state = now
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(star.select(F.col("lo"), F.col("lo")).distinct())


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b): only the components that these tie together are worked on."""
    of = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    ends = links.join(of, "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    nodes = found.union(links.select("a", "a").union(links.select("b", "b")).join(of.select("a"), "a", "left_anti").distinct())
    tied = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return cut(nodes.join(tied, "component", "left").select("node", F.coalesce("whole", "component").alias("component")))


def _digest(star: DataFrame) -> tuple:
    return tuple(star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi", F.lit(1)))).first())
