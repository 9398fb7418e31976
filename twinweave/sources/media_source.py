"""Folders of media files as a Spark data source: ``spark.read.format("media_files").load(root)``.

The driver walks folders without looking at files; every folder (or several small ones) is a partition, so listing, file
times and headers are the work of tasks. Filters on ``extension`` are taken over and settle which files are looked at.
With ``headers`` a file's dimensions are read from its first bytes; more is read only if the header says that they lie
further behind, and ``bytes_read`` tells how much it was. A root inside which some folder refuses to be listed gives the
files at its top alone, which is known by the type of the error; a root that refuses itself is an error. Files that go meanwhile are passed over, files
whose header cannot be read have the reason in ``error``.

The files must be visible to all executors under the same path (a mounted share); for other stores see ``files.scan``.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from twinweave.functions import paths
from twinweave.sources.images import dimensions

SCHEMA = "file_path string, extension string, file_size long, modified_at timestamp, width int, height int, bytes_read long, error string"
#: Bytes of a header at first, and the least that is read at a time beyond them (a quarter of what was read, if that is more).
FIRST_BYTES, MORE_BYTES = 4096, 65536
#: Folders of a partition at most.
FOLDERS_EACH = 64


@dataclass
class Folders(InputPartition):
    """Folders that one task lists."""

    paths: tuple[str, ...]


def extension_of(name: str) -> str:
    """The lower-case extension of a file name, with its dot; none for names without."""
    at = name.rfind(".")
    return name[at:].lower() if at >= 0 else ""


def walked(root: str, deep: bool) -> list[str]:
    """The root and the folders below it, or the root alone if some folder refuses; links to folders are not followed."""
    out, waiting = [], [root]
    while waiting:
        folder = waiting.pop()
        try:
            with os.scandir(folder) as found:
                inner = sorted(x.path for x in found if x.is_dir(follow_symlinks=False))
        except PermissionError:
            if folder == root:
                raise
            return [root]
        except FileNotFoundError:
            if folder == root:
                raise
            continue
        out.append(folder)
        waiting += reversed(inner) if deep else []
    return out


def header(path: str) -> tuple[int | None, int | None, int, str | None]:
    """(width, height, bytes read, error) of a file: its beginning, and more of it while that ends too early."""
    data, size = b"", FIRST_BYTES
    try:
        with open(path, "rb") as f:
            while True:
                more = f.read(size - len(data))
                data += more
                try:
                    width, height = dimensions(data)
                    return width, height, len(data), None
                except (struct.error, IndexError, KeyError, ValueError, TypeError) as e:
                    known = data[:4] in (b"\x89PNG", b"GIF8", b"RIFF", b"II*\0", b"MM\0*") or data[:2] in (b"BM", b"\xff\xd8")
                    if not more or not known or len(data) < size:
                        return None, None, len(data), f"{type(e).__name__}: {e}"
                    size += max(MORE_BYTES, len(data) // 4)
    except OSError as e:
        return None, None, len(data), f"{type(e).__name__}: {e.strerror}"


class MediaReader(DataSourceReader):
    """Lists folders; see the module."""

    def __init__(self, root: str, kinds: str, deep: bool, headers: bool):
        self.root, self.deep, self.headers = os.path.abspath(root), deep, headers
        self.wanted = {"image": paths.IMAGE_EXTENSIONS, "video": paths.VIDEO_EXTENSIONS, "media": (*paths.IMAGE_EXTENSIONS, *paths.VIDEO_EXTENSIONS)}[kinds]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the extension choose files; all others stay with Spark."""
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) and f.attribute == ("extension",) else f.value if isinstance(f, In) and f.attribute == ("extension",) else None
            if values is None:
                yield f
            else:
                self.wanted = tuple(x for x in self.wanted if x in values)

    def partitions(self) -> Sequence[InputPartition]:
        folders = walked(self.root, self.deep) if self.wanted else []
        each = max(1, min(FOLDERS_EACH, len(folders) // 64))
        return [Folders(tuple(folders[k : k + each])) for k in range(0, len(folders), each)] or [Folders(())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for folder in partition.paths:
            try:
                with os.scandir(folder) as found:
                    files = sorted((x for x in found if extension_of(x.name) in self.wanted and x.is_file()), key=lambda x: x.name)
            except FileNotFoundError:
                continue
            for x in files:
                try:
                    held = x.stat()
                except FileNotFoundError:
                    continue
                width, height, read, error = header(x.path) if self.headers else (None, None, 0, None)
                yield x.path, extension_of(x.name), held.st_size, datetime.fromtimestamp(held.st_mtime_ns // 1000 / 1e6, UTC), width, height, read, error


class MediaSource(DataSource):
    """Options: ``kinds`` (image, video or media), ``recursive`` (true), ``headers`` (false)."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        told = lambda k, default: str(self.options.get(k, default)).lower()
        if "path" not in self.options:
            raise ValueError("media_files needs the path of a folder")
        return MediaReader(self.options["path"], told("kinds", "image"), told("recursive", "true") == "true", told("headers", "false") == "true")


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MediaSource)
