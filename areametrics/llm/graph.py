"""Connected components of links, by alternating large and small stars.

A star is a join and a grouped minimum over the links, and a round is one star of each kind. Links
are written to the shared folder after each star: lost executors cost a star at most, and plans stay
small. Spark's driver sets aside 4 MB of heap for each stage, scan and broadcast that it starts, and
starts all that a plan has ready at once. Nothing but a number reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areametrics.sources.shared import stored


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no other, or larger neighbours only."""
    one = F.struct(F.col("a").alias("id"), F.lit(1).alias("up"))
    other = F.struct(F.col("b").alias("id"), F.lit(0).alias("up"))
    degrees = edges.select(F.inline(F.array(one, other))).groupBy("id").agg(
        F.count("*").alias("n"), F.sum("up").alias("up")
    )
    return not degrees.where("up > 1 OR (up = 1 AND n > 1)").agg(F.count("*")).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the least in reach instead."""
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.select(F.inline(F.array(F.struct("a", "b"), turned)))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``a > b`` here: every smaller neighbour, and the node itself, is linked with the least."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    end = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
    return edges.join(least, "a").select(end.alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component``, the least id reachable, for every end of ``links`` (``a``, ``b``).

    Links with a null end or with one end twice are left out.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges = stored(edges, "links")
    while not _settled(edges):
        edges = stored(_small_star(stored(_large_star(edges), "links")), "links")
    leaves = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)
