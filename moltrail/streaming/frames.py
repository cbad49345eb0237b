"""The frame-wise operators on streams of coordinates: they keep no state between frames, so each
micro-batch of whole frames gives the same rows as the batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read_frames(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The coords table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Writes the operator's rows for each micro-batch as Parquet, once each: a batch that is tried again
    overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
