"""Folder scans and file lists as DataFrames; contents are read only where they are asked for."""

from __future__ import annotations

import os
from dataclasses import dataclass

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.functions import paths
from twinweave.operators.media import dedup_paths, source_id

_LISTED = "file_path string, file_size long, modified_at timestamp, root string, scan_seq long"


@dataclass(frozen=True)
class ScanRoot:
    """A folder to scan; with no word on depth, deep if it has folders inside (as the driver sees it; on other file systems deep)."""

    path: str
    recursive: bool | None = None

    @property
    def deep(self) -> bool:
        if self.recursive is not None:
            return self.recursive
        try:
            with os.scandir(self.path) as found:
                return any(x.is_dir() for x in found)
        except OSError:
            return True


def add_root(roots: list[ScanRoot], root: ScanRoot) -> list[ScanRoot]:
    """The list with one more root; an error if it is there already, whatever its case."""
    if any(r.path.lower() == root.path.lower() for r in roots):
        raise ValueError(f"{root.path} is listed already")
    return [*roots, root]


#: What file systems raise when they refuse a folder.
_REFUSALS = ("java.nio.file.AccessDeniedException", "org.apache.hadoop.fs.PathAccessDeniedException", "org.apache.hadoop.security.AccessControlException")


def refused(error: BaseException) -> bool:
    """Whether an error of Spark comes from a folder that may not be listed, by the classes of its causes."""
    cause = getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    while cause is not None:
        if cause.getClass().getName() in _REFUSALS:
            return True
        cause = cause.getCause()
    return False


def _listing(spark: SparkSession, path: str, deep: bool) -> DataFrame:
    """Files of a folder; if some folder inside refuses, of the top alone."""

    def load(recursive: bool) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true").load(path)

    try:
        return load(deep)  # the folders are listed here
    except (PySparkException, Py4JJavaError) as e:
        if not deep or not refused(e):
            raise
        return load(False)


def scan(spark: SparkSession, roots: list[ScanRoot], kinds: str = "image") -> DataFrame:
    """Media files under the roots, each path once, with size, time and the first root that holds it.

    Spark lists the folders; file contents are pruned from the scan. Later roots only add provenance. A root
    whose folders cannot all be listed gives the files at its top alone.
    """
    test = {"image": paths.is_image, "video": paths.is_video, "media": paths.is_media}[kinds]
    listed = None
    for seq, root in enumerate(roots):
        files = _listing(spark, root.path, root.deep)
        path = F.regexp_replace("path", "^file:/*", "/")
        found = files.select(path.alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), F.lit(root.path).alias("root"), F.lit(seq).cast("long").alias("scan_seq")).where(test("file_path"))
        listed = found if listed is None else listed.unionByName(found)
    return spark.createDataFrame([], _LISTED) if listed is None else listed


def media_from_listing(listed: DataFrame) -> DataFrame:
    """Media rows of a listing: each path once, classified, with parts of its path and a stable id."""
    return dedup_paths(listed).withColumns({"source_id": source_id("file_path"), "media_type": paths.media_type("file_path"), "file_name": paths.file_name("file_path"), "extension": paths.extension("file_path"), "directory": paths.directory("file_path")})


def with_file_times(media: DataFrame) -> DataFrame:
    """Creation and access times and sizes by the file system that the tasks see; nulls and zeros for missing files."""

    def run(batches):
        for rows in batches:
            stats = []
            for path in rows["file_path"]:
                try:
                    s = os.stat(path)
                    stats.append((s.st_size, *(pd.Timestamp(ns // 1000, unit="us") for ns in (s.st_ctime_ns, s.st_mtime_ns, s.st_atime_ns))))
                except OSError:
                    stats.append((0, None, None, None))
            yield pd.DataFrame({"file_path": rows["file_path"], **dict(zip(("stat_size", "created_at", "changed_at", "accessed_at"), map(list, zip(*stats, strict=True)) if stats else ([], [], [], []), strict=True))})

    stats = media.select("file_path").mapInPandas(run, "file_path string, stat_size long, created_at timestamp, changed_at timestamp, accessed_at timestamp")
    return media.join(stats, "file_path")


def model_file(path: str) -> bytes:
    """The bytes of a model file; an error if it is none or missing."""
    if not path.lower().endswith(paths.MODEL_EXTENSIONS):
        raise ValueError("a model file ends in .onnx")
    with open(path, "rb") as f:
        return f.read()
