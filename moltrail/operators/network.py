"""Domains of residues, communities and their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expanded(domains: DataFrame) -> DataFrame:
    """name, residue for ranges name, lo, hi (inclusive): an interval join becomes an equality join. Residues of
    overlapping domains occur more than once; a domain's own overlapping parts count once."""
    return domains.select("name", F.explode(F.sequence("lo", "hi")).alias("residue")).distinct()


def in_domains(df: DataFrame, residue: str, domains: DataFrame, first_part_only: bool = False) -> DataFrame:
    """Rows with the name of each domain that their residue is in."""
    if first_part_only:
        domains = domains.where("part = 0")
    d = expanded(domains).withColumnRenamed("residue", "_residue")
    return df.join(d, df[residue] == d["_residue"]).drop("_residue")


def community_edges(betweenness: DataFrame, communities: DataFrame) -> DataFrame:
    """The sum of betweenness over the residue pairs of two communities, 0 on the diagonal. Cells are summed by
    community on one side before the other side is joined."""
    c = lambda residue, name: communities.select(F.col("residue").alias(residue), F.col("comm_id").alias(name))
    half = betweenness.join(c("row", "c1"), "row").groupBy("c1", "col").agg(F.sum("value").alias("value"))
    rows = half.join(c("col", "c2"), "col").groupBy("c1", "c2").agg(F.sum("value").alias("weight"))
    return rows.withColumn("weight", F.when(F.col("c1") == F.col("c2"), 0.0).otherwise(F.col("weight")))


def node_edges(edges: DataFrame, from_file: bool = True) -> DataFrame:
    """The upper triangle: i <= j with weight above 0 for a file, i < j for computed edges."""
    return edges.where("c1 <= c2 AND weight > 0") if from_file else edges.where("c1 < c2")


def large_communities(communities: DataFrame, least: int = 6) -> DataFrame:
    """Members of communities of at least so many residues."""
    kept = communities.groupBy("comm_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("comm_id")
    return communities.join(kept, "comm_id", "left_semi")


def domain_shares(communities: DataFrame, domains: DataFrame, shift: int = 0) -> DataFrame:
    """For each community and domain the residues in both, as shares of either; 0 where none."""
    members = communities.withColumn("residue", F.col("residue") + shift).distinct()
    both = in_domains(members, "residue", domains).groupBy("comm_id", "name").agg(F.countDistinct("residue").alias("n"))
    sizes = members.groupBy("comm_id").agg(F.count("*").alias("comm_size"))
    spans = expanded(domains).groupBy("name").agg(F.count("*").alias("domain_size"))
    rows = sizes.crossJoin(spans).join(both, ["comm_id", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # communities by domains
    return rows.select("comm_id", "name", "n", (F.col("n") / F.col("comm_size")).alias("of_community"), (F.col("n") / F.col("domain_size")).alias("of_domain"))
