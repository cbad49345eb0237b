"""Writers. Text records are made by column functions and written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .numbers import hybrid


def write_series(df: DataFrame, path: str, time: str, digits: int = 3) -> None:
    """K1: CSV with the time first, numbers with so many digits."""
    rest = [c for c in df.columns if c != time]
    df.select(time, *[F.format_string(f"%.{digits}f", F.col(c).cast("double")).alias(c) for c in rest]).write.csv(path, header=True)


def wide_contacts(contacts: DataFrame, frames: DataFrame, frame: str, pair: str, pairs: list, value: str = "w") -> DataFrame:
    """K2: a column for each pair, 0 where a frame has no contact."""
    rows = contacts.groupBy(frame).pivot(pair, pairs).agg(F.sum(value))
    return frames.select(frame).distinct().join(rows, frame, "left").na.fill(0)


def _six(text: Column) -> Column:
    """Six columns wide, or as wide as it is."""
    return F.lpad(text, F.greatest(F.length(text), F.lit(6)), " ")


def index_lines(groups: DataFrame, per_line: int = 15) -> DataFrame:
    """K3: group, line, text of an index file: a header line, then numbers 15 to a line, of six columns or more."""
    rows = groups.withColumn("line", F.floor(F.col("pos") / per_line) + 1)
    rows = rows.groupBy("group", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "atom_no"))), lambda s: _six(s["atom_no"].cast("string"))), " ").alias("text"))
    heads = groups.select("group").distinct().select("group", F.lit(0).cast("long").alias("line"), F.concat(F.lit("[ "), "group", F.lit(" ]")).alias("text"))
    return heads.unionByName(rows)


def write_index(groups: DataFrame, path: str) -> None:
    """K3: groups in order, each whole in one file, as a line belongs to the header before it. Lines are sorted, and spill, as rows."""
    index_lines(groups).repartitionByRange("group").sortWithinPartitions("group", "line").select("text").write.text(path)


def restraint_lines(groups: DataFrame, force: float = 1000.0) -> DataFrame:
    """K4: position restraints of a group's atoms."""
    return groups.select("pos", F.format_string("%6d   1  %8.1f  %8.1f  %8.1f", F.col("atom_no"), F.lit(force), F.lit(force), F.lit(force)).alias("text"))


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """K5: atoms with a column text in fixed columns; serials over 99999 and residues over 9999 in hybrid-36."""
    name = F.when(F.length("atom_name") >= 4, F.col("atom_name")).otherwise(F.concat(F.lit(" "), F.rpad("atom_name", 3, " ")))
    text = F.format_string("%-6s%5s %-4s %3s %1s%4s    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.coalesce("record", F.lit("ATOM")), hybrid(F.col("serial"), 5), name, "res_name", F.coalesce("chain", F.lit(" ")), hybrid(F.col("res_seq"), 4), "x", "y", "z", F.lit(1.0), F.lit(0.0), F.coalesce("element", F.lit("")))
    return atoms.withColumn("text", text)


def model_lines(atoms: DataFrame, frame: str, order: str) -> DataFrame:
    """K5: frame, part, order, text: for each frame a MODEL line (part 0), its atoms (1) and ENDMDL (2); sorted by these they are a file."""
    body = pdb_lines(atoms).select(frame, F.lit(1).alias("part"), F.col(order).alias("order"), "text")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.format_string("MODEL     %4d", F.col(frame).cast("int")).alias("text")), F.struct(F.lit(2).alias("part"), F.lit("ENDMDL").alias("text")))).alias("e")
    heads = atoms.select(frame).distinct().select(frame, ends).select(frame, "e.part", F.lit(None).cast(body.schema["order"].dataType).alias("order"), "e.text")
    return heads.unionByName(body)


def write_models(atoms: DataFrame, path: str, frame: str, order: str, split: bool = False) -> None:
    """K5: frames in order, each whole in one file; with split a folder for each frame. A frame's lines are sorted, and spill, as rows."""
    rows = model_lines(atoms, frame, order).repartitionByRange(frame).sortWithinPartitions(frame, "part", "order")
    if split:
        rows.select(frame, "text").write.partitionBy(frame).text(path)
    else:
        rows.select("text").write.text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """K6."""
    edges.write.csv(path, header=True)
