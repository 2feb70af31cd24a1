"""Connected components by alternating stars, in DataFrame operations.

Each round hangs every node below the least node it knows (large star), then neighbours below each other (small star).
Only least neighbours are aggregated, never neighbour lists, so a hub of any degree costs a partial aggregate. Edges are
written to the shared folder between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import keep

MAX_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least of it and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """edges point from larger to smaller. Link a node and its smaller neighbours to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; component is the least node that can be reached. Null ends and loops are ignored."""
    now = keep(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sign == seen or not sign.n:
            break
        seen = sign
        now = keep(_small(_large(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
