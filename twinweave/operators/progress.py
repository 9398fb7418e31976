"""Progress of tagged jobs, measured by their tasks.

How many jobs a step will take is not known beforehand, so every job is given half of what is left of the step's band:
finished jobs in full, running ones by the share of their tasks that have ended. What is told never falls, stays below
the end of a band until the step is over, and follows the work within it.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Seconds between two looks.
EVERY = 0.2


def share_of(jobs: list[tuple[bool, int, int]]) -> float:
    """Share of a step from its jobs in order: (over, tasks that ended, tasks)."""
    done, left = 0.0, 1.0
    for over, ended, tasks in jobs:
        left /= 2
        done += left * (1.0 if over else ended / tasks if tasks else 0.0)
    return done


def jobs_of(spark: SparkSession, tag: str, since: int = -1) -> list[tuple[int, bool, int, int]]:
    """(number, over, tasks that ended, tasks) of the jobs under a tag that came after one."""
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    out = []
    for job in sorted(int(x) for x in tracker.getJobIdsForTag(tag)):
        found = tracker.getJobInfo(job)
        if job <= since or not found.isDefined():
            continue
        info = found.get()
        stages = [tracker.getStageInfo(int(s)) for s in info.stageIds()]
        held = [s.get() for s in stages if s.isDefined()]
        out.append((job, info.status().toString() != "RUNNING", sum(s.numCompletedTasks() for s in held), sum(s.numTasks() for s in held)))
    return out


class Meter:
    """Tells a step's name and a share from 0 to 1 that never falls."""

    def __init__(self, spark: SparkSession, tag: str, tell: Callable[[str, float], None] | None):
        self.spark, self.tag, self.tell = spark, tag, tell
        self.shown = 0.0
        self.lock = threading.Lock()

    def show(self, step: str, share: float) -> None:
        with self.lock:
            if share >= self.shown:
                self.shown = share
                if self.tell:
                    self.tell(step, share)

    @contextmanager
    def band(self, step: str, low: float, high: float) -> Iterator[None]:
        """Watch the jobs that the body runs under the tag; their work is shown between low and high. The end of the band is shown by whoever follows."""
        self.show(step, low)
        if not self.tell:
            yield
            return
        since = max((j for j, *_ in jobs_of(self.spark, self.tag)), default=-1)
        over = threading.Event()

        def watch() -> None:
            while not over.wait(EVERY):
                share = low + (high - low) * share_of([x[1:] for x in jobs_of(self.spark, self.tag, since)])
                if share > self.shown and not over.is_set():
                    self.show(step, share)

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            over.set()
            watcher.join()
