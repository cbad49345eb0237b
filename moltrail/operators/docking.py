"""Docking results: score lists, poses, molecules of MOL2 files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ranges import dense_index


def last_wins(scores: DataFrame, key: list[str], line: str) -> DataFrame:
    """Of rows with equal keys the one of the last line. Partial maxima are kept before the shuffle."""
    rest = [c for c in scores.columns if c not in key]
    return scores.groupBy(*key).agg(F.max_by(F.struct(*rest), line).alias("r")).select(*key, "r.*")


def ranked(scores: DataFrame, by: str, tie: str, on: list[str], descending: bool = True) -> DataFrame:
    """Rank within each list; of one list placed() gives the places."""
    order = [F.desc(by) if descending else F.asc(by), F.asc(tie)]
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*on).orderBy(*order)))


def placed(scores: DataFrame, by: str, tie: str, descending: bool = True) -> DataFrame:
    """The place (0, 1, ...) of each row in the order of one list, however long."""
    rows = dense_index(scores.withColumn("_t", F.col(tie)), F.desc(by) if descending else F.asc(by), F.asc("_t"))
    return rows.withColumnRenamed("_i", "place").drop("_t")


def top(scores: DataFrame, n: int, by: str, tie: str, descending: bool = True) -> DataFrame:
    """O1, O2: the first n, kept per partition before they meet."""
    return scores.orderBy(F.desc(by) if descending else F.asc(by), tie).limit(n)


def top_of_each(scores: DataFrame, n: int, by: str, tie: str, on: str) -> DataFrame:
    """Top n of each list; Spark keeps n per task and list before the shuffle."""
    return ranked(scores, by, tie, [on]).where(F.col("rank") <= n)


def common_top(scores: DataFrame, n: int, by: str, ligand: str, on: str) -> DataFrame:
    """Ligands in the top n of every list."""
    lists = scores.select(on).distinct().agg(F.count("*").alias("k"))
    rows = top_of_each(scores, n, by, ligand, on).groupBy(ligand).agg(F.countDistinct(on).alias("m"))
    return rows.crossJoin(F.broadcast(lists)).where("m = k").select(ligand)


def with_poses(ids: DataFrame, scores: DataFrame, ligand: str, position: str) -> DataFrame:
    """Result rows of an id list, in the list's order."""
    return ids.join(scores, ligand).orderBy(position)


def sorted_by_scores(files: DataFrame, scores: str, file: str) -> DataFrame:
    """O3: by the list of scores, element by element."""
    return files.orderBy(scores, file)


def first_of_name(molecules: DataFrame, name: str, order: list[str]) -> DataFrame:
    """One molecule of each name, the first by file and number."""
    rest = [c for c in molecules.columns if c != name]
    return molecules.groupBy(name).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(name, "r.*")


def concatenated(parts: list[DataFrame], name: str | None = None) -> DataFrame:
    """All rows, in the parts' order by `part`; missing columns are null; name renames the group."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("group", F.lit(name)) if name else out


def property_number(text: Column, missing: float = 9999.0) -> Column:
    """a number written with >, < and thousands commas; anything else gives `missing`."""
    return F.coalesce(F.regexp_replace(text, "[><,\\s]", "").try_cast("double"), F.lit(missing))


def by_property(molecules: DataFrame, text: str, limit: float, at_least: bool = True) -> DataFrame:
    v = property_number(F.col(text))
    return molecules.where(v >= limit if at_least else v <= limit)


def select_molecule(molecules: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """F26."""
    return molecules.join(ids.select(name).distinct(), name, "left_semi")


def replace_field(lines: DataFrame, section: str, line_no: int, field: int, value: str | Column) -> DataFrame:
    """The n-th blank-separated field of a line of a section."""
    parts = F.split("text", r"\s+")
    changed = F.array_join(F.transform(parts, lambda x, i: F.when(i == field, value if isinstance(value, Column) else F.lit(value)).otherwise(x)), " ")
    return lines.withColumn("text", F.when((F.col("section") == section) & (F.col("line_no") == line_no), changed).otherwise(F.col("text")))


def complexes(receptor: DataFrame, poses: DataFrame) -> DataFrame:
    """For each ligand the receptor's rows, then the pose's. receptor is one structure, repeated for each ligand."""
    each = receptor.crossJoin(poses.select("ligand_id").distinct()).withColumn("part", F.lit(0))
    return each.unionByName(poses.withColumn("part", F.lit(1)), allowMissingColumns=True)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of the first that the second lacks."""
    return a.subtract(b)
