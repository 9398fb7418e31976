"""Ownership of written tables: one folder for a run, gone after a session, and after a killed one."""

import os
import signal
import subprocess
import sys
import time

import pytest

from twinweave.operators import runs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SESSION = """
import os, signal, sys, time
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
from twinweave.operators.checkpoints import materialise
made = materialise(spark.range(5), "numbers")
assert made.count() == 5
print("FILES", sum(len(f) for _, _, f in os.walk(sys.argv[1])), flush=True)
if sys.argv[2] == "killed":
    os.kill(os.getpid(), signal.SIGKILL)
if sys.argv[2] == "stopped":
    spark.stop()
if sys.argv[2] == "failed":
    raise SystemExit(3)
"""


def session(folder, how):
    said = subprocess.run([sys.executable, "-c", SESSION, str(folder), how], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert int(said.stdout.split("FILES")[1]) > 3, said.stderr
    return said.returncode


def held(folder):
    """What lies in a folder, but for the empty one that Spark makes for its own checkpoints."""
    return sorted(x for x in os.listdir(folder) if x.startswith("run-") or x == "other")


@pytest.mark.parametrize("how", ["left", "stopped", "failed"])
def test_the_folder_is_empty_after_a_session(tmp_path, how):
    assert session(tmp_path, how) == (3 if how == "failed" else 0)
    assert held(tmp_path) == [] and not any(files for _, _, files in os.walk(tmp_path))


def test_a_killed_session_is_swept_by_a_later_one(spark, tmp_path):
    assert session(tmp_path, "killed") == -signal.SIGKILL
    (left,) = held(tmp_path)
    (tmp_path / "other").mkdir()  # not a run
    now = runs.touch(spark, f"file://{tmp_path}/run-mine")
    assert runs.sweep(spark, f"file://{tmp_path}", now) == []  # it might live
    old = time.time() - runs.STALE - 100
    os.utime(tmp_path / left / "_alive", (old, old))
    assert runs.sweep(spark, f"file://{tmp_path}", now) == [left]
    assert held(tmp_path) == ["other", "run-mine"]


def test_one_folder_for_a_run_that_can_be_released(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = runs.folder_of(spark, root)
    assert runs.folder_of(spark, root + "/") == first and os.path.exists(first.removeprefix("file://") + "/_alive")
    runs.release(next(r for r in runs._runs.values() if r.folder == first))
    assert held(tmp_path) == []
    again = runs.folder_of(spark, root)
    assert again != first
    runs.release(next(r for r in runs._runs.values() if r.folder == again))
