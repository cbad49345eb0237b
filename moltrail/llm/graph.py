"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _with_least(edges: DataFrame) -> DataFrame:
    """u, v and m, the least of u and all its v. Minima are combined before the shuffle, and the join back
    is one that Spark can split where a node has very many edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, root for each node of edges (u, v): root is the least node that can be reached; roots are left out.
    Each round is written to the shared checkpoint folder. Rounds grow with the logarithm of the longest path."""
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large.where("u <> v")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, edges = edges, cut_lineage(small.where("u <> v").distinct())
        if before.count() == edges.count() and edges.join(before, ["u", "v"], "left_anti").isEmpty():  # the same edges
            return edges.withColumnsRenamed({"u": "node", "v": "root"})
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
