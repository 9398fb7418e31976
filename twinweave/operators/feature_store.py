"""A written table of features, keyed by what a file was and by the settings that its features depend on.

A row belongs to a file identity (path whatever its case, size, time of change) and to a digest of settings. Features
are current if the table has that identity under that digest; all others are found by an anti-join of two narrow
column sets and computed, nothing else is. A change of the model, its input or how images are prepared is another digest, so all
rows are stale; a change of the threshold is none. Each update is a batch of its own, ``digest=.../batch=n``, written once:
readers never see half a batch, and of two updates at the same time the second fails rather than repeat rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.config import Settings
from twinweave.functions import paths
from twinweave.functions.vectors import has_features
from twinweave.operators.checkpoints import materialise_with

_KEYS = ["path_key", "size_key", "time_key"]
_STORED = "path_key string, size_key long, time_key long, features array<float>, batch long"


@dataclass(frozen=True)
class Update:
    """What an update did: rows computed (those without features among them), and its batch number, none if nothing was stale."""

    computed: int
    batch: int | None


def identity(media: DataFrame, path: str = "file_path", size: str = "file_size", time: str = "modified_at") -> DataFrame:
    """Rows with the columns of a file's identity; a null size or time is a value of its own."""
    return media.withColumns({"path_key": F.coalesce(paths.path_key(path), F.lit("")), "size_key": F.coalesce(F.col(size).cast("long"), F.lit(-1)), "time_key": F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(1 << 62)))})


class FeatureStore:
    """Features in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, settings: Settings) -> str:
        return f"{self.folder}/digest={settings.features_digest()}"

    def _batches(self, settings: Settings) -> list[int]:
        """Numbers of the batches that are written to their end."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(settings))
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(place):
            return []
        found = [x.getPath() for x in fs.listStatus(place) if x.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName()[6:]) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def stored(self, settings: Settings) -> DataFrame:
        """(path_key, size_key, time_key, features, batch) under these settings."""
        numbers = self._batches(settings)
        if not numbers:
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.option("basePath", self._path(settings)).schema(_STORED).parquet(*[f"{self._path(settings)}/batch={n}" for n in numbers])

    def stale(self, media: DataFrame, settings: Settings) -> DataFrame:
        """Media rows without current features, one for each identity; features are not read."""
        return identity(media).join(self.stored(settings).select(*_KEYS), _KEYS, "left_anti").dropDuplicates(_KEYS)

    def update(self, media: DataFrame, derive: Callable[[DataFrame], DataFrame], settings: Settings) -> Update:
        """Compute what is stale. ``derive`` adds ``features`` to media rows; a row whose features stay null is kept as such, so it is not tried again."""
        batch = max(self._batches(settings), default=-1) + 1
        fresh, n = materialise_with(self.stale(media, settings), "stale", F.count(F.lit(1)))
        if n:
            made = derive(fresh).select(*_KEYS, F.col("features").cast("array<float>").alias("features"))
            made.write.mode("errorifexists").parquet(f"{self._path(settings)}/batch={batch}")
        return Update(n, batch if n else None)

    def featured(self, media: DataFrame, settings: Settings) -> DataFrame:
        """Media rows with their current features and the batch that made them (in place of columns of these names); rows without are left out."""
        return identity(media).drop("features", "batch").join(self.stored(settings).where(has_features("features")), _KEYS).drop(*_KEYS)
