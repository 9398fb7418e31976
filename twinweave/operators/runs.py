"""Who owns written tables: a folder for each run, and what becomes of it.

All tables of an application lie in one folder below spark.checkpoint.dir. A file in it is touched again and again while
the driver lives. The folder is removed when the driver ends; folders of runs whose driver was killed are removed by the
next run that finds them untouched for STALE seconds, by the clock of the file system that holds them.
"""

from __future__ import annotations

import atexit
import threading
import uuid
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

#: Seconds between touches, and after which a run that was not touched is dead.
TOUCH_EVERY, STALE = 60.0, 3600.0
_ALIVE, _PREFIX = "_alive", "run-"


@dataclass
class Run:
    """A run's folder and the thread that keeps it alive."""

    spark: SparkSession
    root: str
    folder: str
    over: threading.Event
    conf: JavaObject  # of the file systems; outlives the context


_runs: dict[tuple[str, str], Run] = {}


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def touch(spark: SparkSession, folder: str) -> int:
    """Say that a run lives; the file system's time of that, in milliseconds."""
    fs, place = _place(spark, f"{folder}/{_ALIVE}")
    fs.create(place, True).close()
    return int(fs.getFileStatus(place).getModificationTime())


def sweep(spark: SparkSession, root: str, now: int, stale: float = STALE) -> list[str]:
    """Remove the folders of runs that were not touched for so many seconds before ``now``; their names."""
    fs, place = _place(spark, root)
    gone = []
    for x in fs.listStatus(place):
        name = x.getPath().getName()
        if x.isDirectory() and name.startswith(_PREFIX):
            alive = spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), _ALIVE)
            seen = fs.getFileStatus(alive).getModificationTime() if fs.exists(alive) else x.getModificationTime()
            if now - seen > 1000 * stale and fs.delete(x.getPath(), True):
                gone.append(name)
    return gone


def release(run: Run) -> None:
    """Stop keeping a run alive and remove its folder; nothing may read its tables any more."""
    _runs.pop((run.spark.sparkContext.applicationId, run.root), None)
    run.over.set()
    fs, place = _place(run.spark, run.folder)
    fs.delete(place, True)


def _at_exit(run: Run) -> None:
    if not run.over.is_set():
        run.over.set()
        # the context may be stopped, its gateway may be gone
        try:
            place = run.spark._jvm.org.apache.hadoop.fs.Path(run.folder)
            place.getFileSystem(run.conf).delete(place, True)
        except (Py4JError, OSError, AttributeError):
            return


def folder_of(spark: SparkSession, root: str) -> str:
    """The folder of this application's tables below a root; the first call makes it and removes those of dead runs."""
    root = root.rstrip("/")
    key = (spark.sparkContext.applicationId, root)
    if key in _runs:
        return _runs[key].folder
    run = Run(spark, root, f"{root}/{_PREFIX}{key[0]}-{uuid.uuid4().hex[:8]}", threading.Event(), spark._jsc.hadoopConfiguration())
    sweep(spark, root, touch(spark, run.folder))
    _runs[key] = run

    def keep() -> None:
        while not run.over.wait(TOUCH_EVERY):
            if spark.sparkContext._jsc is None:  # stopped
                return
            touch(spark, run.folder)

    threading.Thread(target=keep, daemon=True).start()
    atexit.register(_at_exit, run)
    return run.folder
