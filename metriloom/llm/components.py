"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriloom.session import written


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node that has an edge; ``root`` is the smallest node of its component.

    Each round is written to the shared folder, which cuts the lineage. Minima are combined before the
    shuffle and joins on a hub are split by AQE, so a node with very many neighbours fits. Loops,
    repeated edges and null ends are ignored; no edges give an empty table.
    """
    current = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    seen = None
    while True:
        current = written(current, "edges")
        sign = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sign == seen or not sign[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = sign
        current = _small_star(_large_star(current))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    tied = edges.join(low, "u")
    return tied.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
        low.select("u", F.col("low").alias("v"))
    ).distinct()
