"""Tables in the shared checkpoint folder: they cut lineage and outlive executors.

A written table needs no shuffle files any more, so those of its write are removed at its end. A table that
nothing will read again is removed by ``discard``; what a returned frame reads stays until the driver ends (see ``runs``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from twinweave.operators.runs import folder_of
from twinweave.workers import BATCH_BYTES

#: How tables are written: shuffle files go at the end, and what Python workers are sent at once is bounded.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
#: Columns of hashes or packed rows: a dictionary of their values would be made in vain.
_WRITING |= {f"parquet.enable.dictionary#{name}": "false" for name in ("h", "first", "last", "blob")}
LOCAL_DEFAULT = "/tmp/twinweave-checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; without one, a default on local masters and an error on others."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_DEFAULT
        spark.sparkContext.setCheckpointDir(root)
    return f"{folder_of(spark, root)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside run under the settings for writing."""
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with writing(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def materialise_with(df: DataFrame, name: str, figure: Column):
    """(the written table, an aggregate of its rows that was taken while it was written)."""
    seen = Observation()
    made = materialise(df.observe(seen, figure.alias("figure")), name)
    return made, seen.get["figure"]


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more; frames that were not written here, and removed ones, are passed over."""
    for table in tables:
        path = table.__dict__.pop("written_to", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
