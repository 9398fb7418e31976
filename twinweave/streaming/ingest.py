"""New files as a stream, and an idempotent write of what is derived from them.

Average linkage cannot be maintained under insertion, so the stream keeps the feature table up to date and
clusters are made anew from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinweave.functions import paths


def stream_files(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content) of image files as they appear."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(folder)
    return files.where(paths.is_image("path"))


def keep_features(files: DataFrame, derive: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """Write ``derive(batch)`` into a Parquet folder by batch number, so that a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        derive(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
