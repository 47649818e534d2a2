"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.session import materialise


def connected_components(edges: DataFrame, group: tuple[str, ...] = (), a: str = "a", b: str = "b") -> DataFrame:
    """``(group..., node, component)`` for every node with an edge; the component is its lowest node.

    Large-star and small-star rounds, each of them an aggregate with map-side combine and an
    equi-join whose output never exceeds the edge table; adaptive execution splits the join of
    a node with very many neighbours. Each round is checkpointed; the loop stops when every
    component is a star around its lowest node.
    """
    keys = list(group)
    links = edges.select(*keys, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    links = materialise(links.distinct())
    while not _all_stars(links, keys):
        links = materialise(_small_star(_large_star(links, keys), keys))
    members = links.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _all_stars(links: DataFrame, keys: list[str]) -> bool:
    """True if every node with a link upwards has exactly one, to a node without any."""
    ends = links.select(*keys, F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    ends = ends.unionByName(links.select(*keys, F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    degree = ends.groupBy(*keys, "node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return degree.where("up > 1 or (up = 1 and root = 1)").isEmpty()


def _large_star(links: DataFrame, keys: list[str]) -> DataFrame:
    """Connect every larger neighbour of a node to the lowest node around it."""
    both = links.select(*keys, "u", "v").union(links.select(*keys, F.col("v"), F.col("u")))
    low = both.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    low = low.select(*keys, "u", F.least("m", "u").alias("m"))
    # only links to a larger neighbour are rewritten, so one direction is enough for the join
    up = links.select(*keys, F.col("v").alias("u"), F.col("u").alias("w"))
    return up.join(low, [*keys, "u"]).select(*keys, F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, keys: list[str]) -> DataFrame:
    """Connect a node and its smaller neighbours to the lowest of them."""
    low = links.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    moved = links.join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select(*keys, "u", F.col("m").alias("v"))
    return moved.union(own).where("u <> v").distinct()
