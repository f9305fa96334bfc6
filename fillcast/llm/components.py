"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillcast.operators.ordered import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): each node of an edge with the smallest node it reaches.

    Every step is one aggregate for the smallest neighbour (combined before its shuffle, so a node with
    many neighbours is no hot spot) and one join back that adaptive execution may split. A round's edges
    are written to the shared folder, which ends the lineage. NULL ends and loops are left out; no edges
    give no rows.
    """
    e = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    seen = _mark(e)
    while seen[0]:
        e = stored(_small_star(_large_star(e)))
        now = _mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))


def _mark(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.sum(h % 1_000_000_007), F.bit_xor(h)).first())


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
