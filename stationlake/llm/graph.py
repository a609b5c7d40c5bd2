"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm.frames import stored


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``rep`` and ``component`` (smallest member) of every node that has a link to another.

    Each round moves a node's larger neighbours, then its smaller ones, to the
    smallest it knows; the number of rounds grows with the logarithm of the
    longest path. Rounds start from written tables.
    """
    larger = F.greatest(u, v).alias("u")
    edges = stored(links.filter(F.col(u) != F.col(v)).select(larger, F.least(u, v).alias("v")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        edges = stored(_small_star(_large_star(edges)), "edges")
    return edges.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("rep"), F.col("v").alias("component")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
