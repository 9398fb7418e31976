"""Python workers and this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that a Python worker is sent at once, unless the session says otherwise; rows may be long texts. Both sides hold a batch or two for each task.
BATCH_BYTES = 4 << 20


def reachable(spark: SparkSession) -> SparkSession:
    """Tell Python workers where the package lies, for sessions that were not started in its folder, and bound what they are sent.

    This serves workers that see the driver's folders; on others, ship the package with ``--py-files``.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = spark.sparkContext.environment
    known = [p for p in held.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        held["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark
