"""Groups kept in a written table to which removals are merged.

A version holds the members of the groups that it changed, as they were after it, and a head for each of these groups
(its number of members left; a dissolved group has none). What is there now is, for each group, what its latest head's
version holds. A removal finds the groups of its paths by a semi-join, writes those groups alone, and changes nothing if none of its
paths is there, so repeated batches are harmless and the order of batches does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.operators.checkpoints import discard, materialise, materialise_with


@dataclass(frozen=True)
class Removal:
    """Members that a removal took, groups that it touched and dissolved, and its version, none if it changed nothing."""

    removed: int
    touched: int
    dissolved: int
    version: int | None


class GroupState:
    """Members (group_id, ..., file_path) in a folder that all executors share: ``version=n/rows`` and ``version=n/heads``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in fs.listStatus(place)] if fs.exists(place) else []
        # heads are written last: a version without them is none
        return sorted(int(p.getName()[8:]) for p in found if p.getName().startswith("version=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "heads/_SUCCESS")))

    def _write(self, version: int, rows: DataFrame, heads: DataFrame) -> None:
        rows.write.mode("errorifexists").parquet(f"{self.folder}/version={version}/rows")
        heads.write.mode("errorifexists").parquet(f"{self.folder}/version={version}/heads")

    def begin(self, members: DataFrame) -> None:
        """The first version: all members; groups of one are kept, as they are no result of a removal."""
        if self._versions():
            raise ValueError(f"{self.folder} holds a state already")
        held = materialise(members, "members")
        self._write(0, held, held.groupBy("group_id").agg(F.count(F.lit(1)).alias("left")))
        discard(held)

    def heads(self) -> DataFrame:
        """(group_id, left, version): the latest head of every group."""
        parts = [self.spark.read.parquet(f"{self.folder}/version={v}/heads").withColumn("version", F.lit(v)) for v in self._versions()]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("group_id").agg(F.max_by("left", "version").alias("left"), F.max("version").alias("version"))

    def members(self, groups: DataFrame | None = None) -> DataFrame:
        """Members as they are now with ``item_count``, of all groups or of some."""
        heads = self.heads().where(F.col("left") > 0)
        if groups is not None:
            heads = heads.join(groups.select("group_id").distinct(), "group_id", "left_semi")
        parts = [self.spark.read.parquet(f"{self.folder}/version={v}/rows").withColumn("version", F.lit(v)) for v in self._versions()]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.join(heads.withColumnRenamed("left", "item_count"), ["group_id", "version"]).drop("version")

    def remove(self, removed: DataFrame, path: str = "file_path", visible: DataFrame | None = None) -> Removal:
        """Take out members by path (case counts); touched groups with one member or none left are dissolved. Only visible groups are looked at, if some are given."""
        gone = removed.select(path).where(F.col(path).isNotNull()).distinct()
        touched, n = materialise_with(self.members(visible).join(gone, path, "left_semi").groupBy("group_id").agg(F.count(F.lit(1)).alias("k")), "touched", F.count(F.lit(1)))
        if not n:
            discard(touched)
            return Removal(0, 0, 0, None)
        left = self.members(touched).join(gone, path, "left_anti").drop("item_count")
        counts = left.groupBy("group_id").agg(F.count(F.lit(1)).alias("c"))
        heads = materialise(touched.join(counts, "group_id", "left").select("group_id", F.when(F.col("c") > 1, F.col("c")).otherwise(F.lit(0)).cast("long").alias("left"), "k"), "heads")
        version = self._versions()[-1] + 1
        self._write(version, left.join(heads.where(F.col("left") > 0).select("group_id"), "group_id", "left_semi"), heads.select("group_id", "left"))
        k, dissolved = heads.agg(F.sum("k"), F.count_if(F.col("left") == 0)).first()
        discard(touched, heads)
        return Removal(int(k), n, int(dissolved), version)

    def live_counts(self, total_analysed: int) -> DataFrame:
        """Counts after removals, from heads alone; the number analysed is carried."""
        left = F.col("left")
        return self.heads().agg(F.count_if(left > 1).alias("duplicate_groups"), F.count_if(left == 1).alias("single_groups"), F.coalesce(F.sum(F.when(left > 1, left)), F.lit(0)).alias("duplicate_items"), F.lit(total_analysed).cast("long").alias("total_items"))
