"""A versioned manifest of scanned roots, and re-scans as differences of snapshots.

A version holds the listing of one root: (path_key, file_path, file_size, modified_at) as found by one scan. What is
scanned now is, for each root, its latest version; a re-scan therefore writes the rows of its own root alone and
replaces what that root contributed, whatever other roots hold. A file is there while any root holds it; the first root
that held it, by the order of their latest scans, says how its path is written. Differences between two versions of a
root are a full outer comparison by path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.functions import paths
from twinweave.operators.media import dedup_paths

_ROWS = "path_key string, file_path string, file_size long, modified_at timestamp"
_REMOVED = "removed"


def snapshot(listed: DataFrame) -> DataFrame:
    """The rows of a manifest for a listing (file_path, file_size, modified_at): each path once, whatever its case; null paths are left out."""
    rows = listed.where("file_path is not null").select(paths.path_key("file_path").alias("path_key"), "file_path", F.col("file_size").cast("long").alias("file_size"), F.col("modified_at").cast("timestamp").alias("modified_at"))
    return dedup_paths(rows, "file_path")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path_key, change, size_before, size_after): added, changed (size or time) or gone; what is the same is left out. Both hold a path once."""
    side = lambda t, k: t.select("path_key", F.struct("file_size", "modified_at").alias(k))
    both = side(before, "b").join(side(after, "a"), "path_key", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "gone").when(~(F.col("a.file_size").eqNullSafe(F.col("b.file_size")) & F.col("a.modified_at").eqNullSafe(F.col("b.modified_at"))), "changed")
    return both.withColumn("change", change).where("change is not null").select("path_key", "change", F.col("b.file_size").alias("size_before"), F.col("a.file_size").alias("size_after"))


class Manifest:
    """Versions in a folder that all executors share: ``version=n/root=.../``, written once each."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def versions(self) -> list[tuple[int, str, str]]:
        """(number, root's key, what it is: a listing or a removal) of all that are written to their end, in order."""
        fs, place = self._fs(self.folder)
        out = []
        for x in fs.listStatus(place) if fs.exists(place) else []:
            name = x.getPath().getName()
            number, _, rest = name.partition(".")
            kind, _, root = rest.partition(".")
            if number.isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")):
                out.append((int(number), bytes.fromhex(root).decode(), kind))
        return sorted(out)

    def _write(self, rows: DataFrame, root: str, kind: str) -> int:
        number = max((n for n, _, _ in self.versions()), default=0) + 1
        rows.write.mode("errorifexists").parquet(self._path(number, root.lower(), kind))
        return number

    def _path(self, number: int, root_key: str, kind: str) -> str:
        return f"{self.folder}/{number}.{kind}.{root_key.encode().hex()}"

    def rescan(self, root: str, listed: DataFrame) -> int:
        """Record a scan of a root; what the root held before counts no more. The number of the version."""
        return self._write(snapshot(listed), root, "listing")

    def remove(self, root: str) -> int:
        """Forget a root; files that other roots hold stay."""
        return self._write(self.spark.createDataFrame([], _ROWS), root, _REMOVED)

    def held(self, root: str, before: int | None = None) -> DataFrame:
        """The rows of a root as of its latest version, or of the one before a number."""
        found = [v for v in self.versions() if v[1] == root.lower() and (before is None or v[0] < before)]
        if not found or found[-1][2] == _REMOVED:
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(self._path(*found[-1]))

    def changes(self, version: int) -> DataFrame:
        """What a version changed in its root: (path_key, change, size_before, size_after)."""
        root = next(v[1] for v in self.versions() if v[0] == version)
        return compared(self.held(root, version), self.held(root, version + 1))

    def listing(self) -> DataFrame:
        """(file_path, file_size, modified_at, root, scan_seq) of all roots as they are now, as a scan gives them."""
        latest = {root: (n, kind) for n, root, kind in self.versions()}
        out = self.spark.createDataFrame([], "file_path string, file_size long, modified_at timestamp, root string, scan_seq long")
        for root, (n, kind) in latest.items():
            if kind != _REMOVED:
                out = out.unionByName(self.held(root).select("file_path", "file_size", "modified_at", F.lit(root).alias("root"), F.lit(n).cast("long").alias("scan_seq")))
        return out

    def media(self) -> DataFrame:
        """(file_path, file_size, modified_at, root, scan_seq): each file once, by the root that held it first."""
        return dedup_paths(self.listing())
