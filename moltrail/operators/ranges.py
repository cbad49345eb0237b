"""Row numbers and running sums over whole tables, without a task that holds all rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _checkpoint_folder(context) -> None:
    """Sets the folder that spark.checkpoint.dir names; where it is unset, a local one in local mode only."""
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or "/tmp/moltrail-checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder that all executors share."""
    _checkpoint_folder(df.sparkSession.sparkContext)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, for tables that are written and read again."""
    _checkpoint_folder(spark.sparkContext)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in ranged, sorted partitions, with the number of the partition (_p) and of the row in it (_k). They are written
    once: were they made anew for the counts, the ranges, which are drawn from a sample, could differ."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    return cut_lineage(rows.select(*df.columns, F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_k")))


def _before(parts: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """_p and for each name the sum over all partitions before it: a row for each partition."""
    w = W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    each = parts.groupBy("_p").agg(*[s.alias(f"_s_{k}") for k, s in sums.items()])
    return F.broadcast(each.select("_p", *[F.coalesce(F.sum(f"_s_{k}").over(w), F.lit(0)).alias(f"_b_{k}") for k in sums]))


def dense_index(df: DataFrame, *order: str | Column) -> DataFrame:
    """A column _i: 0, 1, ... in the order of the keys."""
    rows = _ranged(df, [F.col(c) if isinstance(c, str) else c for c in order])
    return rows.join(_before(rows, {"n": F.count("*")}), "_p").withColumn("_i", F.col("_b_n") + F.col("_k")).drop("_p", "_k", "_b_n")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """For each name of sums the sum of its column up to and with the row, in an order without ties."""
    rows = _ranged(df, order)
    w = W.partitionBy("_p").orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumns({f"_l_{k}": F.sum(c).over(w) for k, c in sums.items()})
    out = local.join(_before(rows, {k: F.sum(c) for k, c in sums.items()}), "_p")
    return out.withColumns({k: F.col(f"_l_{k}") + F.col(f"_b_{k}") for k in sums}).drop("_p", "_k", *[f"_{x}_{k}" for x in "lb" for k in sums])
