"""Connected components of links, without collecting them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import discard, materialize


def components(links: DataFrame, name: str = "cc") -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``links`` (columns a, b).

    Alternates large-star and small-star steps: every edge is moved to the smallest known neighbour until
    all edges point from a node to its component's smallest. Each step aggregates by node with
    map-side combining, is written to the shared folder, and the number of rounds grows with the
    logarithm of the longest chain. Joins on a node with very many edges are split by adaptive execution.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        # large star: each larger neighbour is linked to the smallest of the neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each smaller neighbour, and the node itself, is linked to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        moved = materialize(small.where("u <> v").distinct(), name)
        # a star: no node is both an end and a centre, and no end has two centres
        ends, centres = moved.select("u"), moved.select(F.col("v").alias("u"))
        still = ends.intersect(centres).limit(1).count() or moved.groupBy("u").count().where("count > 1").limit(1).count()
        discard(edges)
        edges = moved
        if not still:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
