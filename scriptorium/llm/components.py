"""Connected components of a graph of long identifiers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collected, cut, remove

MAX_BROADCAST = 200_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, nodes: DataFrame, small: bool) -> DataFrame:
    """Every neighbour above a node goes to the node's smallest neighbour (column ``m`` of ``nodes``)."""
    least = nodes.select("u", F.least("u", "m").alias("m"))
    above = edges.select(F.col("v").alias("u"), F.col("u").alias("above"))
    moved = above.join(F.broadcast(least) if small else least, "u").select(F.col("above").alias("u"), F.col("m").alias("v"))
    return moved if small else moved.distinct()


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """A node and its neighbours below it go to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(F.broadcast(least) if small else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``node, root`` of every node that has an edge; ``root`` is the smallest node of its component.

    ``edges`` has ``u, v`` (either order, repeats and loops allowed). Each round is written to the
    shared folder; rounds grow with the logarithm of the largest component's size. They end when all
    edges make stars: each node has only neighbours above it, or just one. No edge reaches the driver, only two
    numbers a round.

    What a round costs the driver are its tasks, whatever they hold. So the smallest neighbours of ``most`` nodes at most
    are broadcast, and edges then move once a round.
    """
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    while True:
        nodes = cut(_both(now).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "components-nodes")
        n, left = nodes.agg(F.count("*"), F.count_if(F.expr("m < u AND n > 1"))).first()
        if not left:
            remove(nodes)
            collected(now.sparkSession)
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        new = cut(_small_star(_large_star(now, nodes, n <= most), n <= most), "components")
        remove(now)
        remove(nodes)
        now = new
