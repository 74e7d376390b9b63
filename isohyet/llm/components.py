"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from isohyet.llm.common import hot_from, joined_by_key, materialise


def _large_star(edges: DataFrame, total: int, hubs: bool) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    up = both.filter("b > a")
    joined = joined_by_key(up, least, "a", "n", total) if hubs else up.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int, hubs: bool) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    joined = joined_by_key(down, least, "a", "n", total) if hubs else down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _ends(edges: DataFrame) -> Row:
    """stars: every node has one edge to a smaller one at most, and no node has edges to both sides; total and most: ends of edges, in all and at one node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    stars = (F.col("up") == 0) | ((F.col("up") == 1) & (F.col("n") == 1))
    return nodes.agg(F.coalesce(F.min(stars), F.lit(True)).alias("stars"), F.sum("n").alias("total"), F.max("n").alias("most")).first()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component for every node of the edges (a, b): the smallest node it can reach.

    Nodes are non-null longs. Loops and repeated edges do no harm; no edges give no rows.
    One aggregate a round tells whether it is the last. A minimum per node is aggregated before it is joined back; to the edges of a hub it is
    broadcast, so that they are never gathered in one place. Each round is written to the shared folder.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    while not (ends := _ends(now)).stars:
        total, hubs = ends.total, ends.most > hot_from(ends.total)
        large = _large_star(now, total, hubs)
        if hubs:  # keeps the plan of the next step short
            large = materialise(large.distinct(), name)
        now = materialise(_small_star(large, total, hubs).filter("a <> b").distinct(), name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
