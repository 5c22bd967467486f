"""Connected components of links between ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.llm.common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to u's smallest neighbour, or u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    # Repeats go with the next grouping; an exchange only for them would cost more.
    return (
        both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), "m")
    return moved.unionByName(least).select("u", F.col("m").alias("v")).distinct()


def component_stars(links: DataFrame, tables: Workspace) -> DataFrame:
    """(u, v) for every linked id u but the smallest of its component, which is v.

    ``links`` has columns (u, v) in any order and with repeats.  Each round is written,
    so a lost executor repeats a round at most; the rounds are about the logarithm of the
    longest path.
    """
    edges = tables.written(
        links.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    while True:
        edges = tables.written(_small_star(_large_star(edges)))
        if _all_stars(edges):
            return edges


def _all_stars(edges: DataFrame) -> bool:
    """No id is the start of two links, or the end of one and the start of another."""
    starts = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    ids = starts.unionByName(ends).groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ids.where("out > 1 or (out = 1 and into = 1)").isEmpty()
