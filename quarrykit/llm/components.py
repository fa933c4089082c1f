"""Connected components by alternating large-star and small-star, as joins and aggregates.

Each step is a table in the shared folder, so lineage stays short and a lost executor
recomputes one step at most.  A node's smallest neighbour comes from a partially
aggregated groupBy, and the joins are plain equi-joins that adaptive execution can
split, so a star of any size passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of u to the smallest of u and its neighbours."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links u and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, component), the component being the smallest node reached. Nodes without edges do not appear."""
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        # Settled once every edge leads to a root: no node is both a lower and an upper end.
        seen = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == before or not seen[0]:
            break
        before = seen
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
