"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import drop, keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of non-null ids to rows (node, root): every linked node but the roots, with its smallest node.

    Each round points every node's larger neighbours at its least neighbour, then its smaller ones; nothing is
    gathered per node but that least neighbour.  Rounds are stage tables; the last one stays.
    """
    ends = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = keep(ends)
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        star, mid = keep(large)
        least = star.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = star.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("x"), "m").where(F.col("x") != F.col("m")).union(least.select("n", "m"))
        new, new_path = keep(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        drop(links.sparkSession, path, mid)
        edges, path, before, state = new, new_path, state, _state(new)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
