"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest node around it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, both sides of the join are plain shuffles, and a node with very many links can be split.
    least = written(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m")), "least")
    return (
        both.where("b > a")
        .join(least, F.col("a") == F.col("n"))
        .where("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")
    moved = (
        down.join(least, F.col("a") == F.col("n"))
        .where("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )
    return moved.union(least).distinct()


def _is_done(links: DataFrame) -> bool:
    """Whether every node has one link and none leads to a node that has a link itself."""
    nodes = links.agg(F.count("*").alias("links"), F.countDistinct("a").alias("nodes")).first()
    if nodes["links"] != nodes["nodes"]:
        return False
    ends = links.select(F.col("b").alias("end")).distinct()
    return links.join(ends, F.col("a") == F.col("end"), "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """For each node of ``links`` (a, b; a written table) but the smallest of its component: node, component.

    A round keeps what is connected and only moves links to smaller nodes, until each node is linked to
    the smallest of its component and to nothing else.
    """
    links = links.where("a <> b").select("a", "b")
    while True:
        links = written(_small_star(written(_large_star(links), "large")), "stars")
        if _is_done(links):
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
