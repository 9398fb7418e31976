"""Media rows: identity by path, provenance by scan root, states and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.functions import paths
from twinweave.functions.vectors import has_features


def source_id(path: Column | str) -> Column:
    """A stable id of a file: the same path, whatever its case, has the same."""
    return F.sha2(paths.path_key(path), 256)


def dedup_paths(files: DataFrame, order: str = "scan_seq", path: str = "file_path") -> DataFrame:
    """The first row of every path (case does not count), by scan order."""
    first = Window.partitionBy(paths.path_key(path)).orderBy(order, path)
    return files.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def provenance(files: DataFrame, path: str = "file_path", root: str = "root") -> DataFrame:
    """(path_key, root_key): which roots a file was found under."""
    return files.select(paths.path_key(path).alias("path_key"), paths.path_key(root).alias("root_key")).distinct()


def remove_root(bridge: DataFrame, root: str) -> DataFrame:
    return bridge.where(F.col("root_key") != F.lower(F.lit(root)))


def with_provenance(media: DataFrame, bridge: DataFrame, path: str = "file_path") -> DataFrame:
    """Media that some root still refers to."""
    return media.withColumn("path_key", paths.path_key(path)).join(bridge.select("path_key"), "path_key", "left_semi").drop("path_key")


def add_files(listed: DataFrame, candidates: DataFrame, path: str = "file_path") -> DataFrame:
    """Image candidates that are not listed yet."""
    key = paths.path_key(path)
    fresh = candidates.where(paths.is_image(path)).withColumn("__key", key).join(listed.select(key.alias("__key")), "__key", "left_anti").drop("__key")
    return fresh


def media_to_items(media: DataFrame, path: str = "file_path") -> DataFrame:
    """One item for every image; nothing derived yet. Videos give none here."""
    return media.where(paths.is_image(path)).withColumns({"frame_index": F.lit(None).cast("int"), "processed": F.lit(False), "features": F.lit(None).cast("array<float>")})


def video_frames(videos: DataFrame, count: Column | str, rate: Column | str = "frame_rate") -> DataFrame:
    """One item for every frame of every video, with its time in seconds."""
    n, rate = (F.col(c) if isinstance(c, str) else c for c in (count, rate))
    frames = videos.withColumn("frame_index", F.explode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
    return frames.withColumn("frame_seconds", F.when(rate > 0, F.col("frame_index") / F.nullif(rate, F.lit(0))))


def processed_items(items: DataFrame, path: str = "processed_path") -> DataFrame:
    return items.where(F.coalesce(F.col(path) != "", F.lit(False)))


def featured_items(items: DataFrame, features: str = "features") -> DataFrame:
    return items.where(has_features(features))


def remove_by_path(items: DataFrame, removed: DataFrame, path: str = "file_path") -> DataFrame:
    """Items whose path (case counts) is not among the removed."""
    return items.join(removed.select(F.col(path)).distinct(), path, "left_anti")


def sources_with_items(sources: DataFrame, items: DataFrame, source: str = "source_id") -> DataFrame:
    """Sources that have an item left."""
    return sources.join(items.select(source).distinct(), source, "left_semi")


def reset_processed(items: DataFrame) -> DataFrame:
    return items.withColumn("processed_path", F.lit(None).cast("string"))


def reset_features(items: DataFrame) -> DataFrame:
    return items.withColumn("features", F.lit(None).cast("array<float>"))


def clear(df: DataFrame) -> DataFrame:
    """No rows of the same schema."""
    return df.limit(0)


def counters(items: DataFrame, path: str = "file_path", features: str = "features", source: str = "source_id", processed: str = "processed_path") -> DataFrame:
    """Sources, items, images, videos, processed items and items with features, in one row; those whose column is not there are 0."""
    held = items.columns
    is_processed = F.coalesce(F.col(processed) != "", F.lit(False)) if processed in held else F.lit(False)
    return items.agg(
        (F.count_distinct(source) if source in held else F.lit(0).cast("long")).alias("n_sources"),
        F.count_if(is_processed).alias("n_processed"),
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(paths.is_image(path)).alias("n_images"),
        F.count_if(paths.is_video(path)).alias("n_videos"),
        F.count_if(has_features(features)).alias("n_featured"),
    )
