"""File actions as plans: rows say what would be done; ``execute`` does it, and only when told to.

Names in a destination are given in selection order: the name itself if it is free, else the smallest n
from 1 on with "stem (n)ext" free, seeing the names given before and those that are there already. No file is
ever overwritten: a target is made only where nothing stands, by a link or an exclusive open.

A real run is done once: its result rows are written, and what is returned reads them. A task that Spark repeats
recognises what its earlier attempt has done by the identity of the sources (device, number, size and
time of change), which is written down before anything is touched.
"""

from __future__ import annotations

import contextlib
import errno
import os
import shutil
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.functions import paths
from twinweave.operators.checkpoints import discard, materialise

_RESULT = "action string, file_path string, target string, ok boolean, error string"
_PLACING = ("Move", "Copy", "Recycle")


def flat_plan(selected: DataFrame, destination: str | None, action: str = "Move") -> DataFrame:
    """(action, dest_dir, file_path, seq) for a list into one folder; no rows without a destination."""
    rows = selected.select(F.lit(action).alias("action"), F.lit(destination).alias("dest_dir"), "file_path", "seq")
    return rows if destination else rows.limit(0)


def grouped_plan(selected: DataFrame, destination: str, action: str = "Move") -> DataFrame:
    """The same into a folder for each group name; a name that cannot be one gives rows with an error."""
    blank = F.coalesce(F.trim("name") == "", F.lit(True))
    name = paths.sanitised_name(F.when(blank, F.lit("x")).otherwise(F.col("name")))
    name = F.when(blank, F.lit(None)).otherwise(name)
    folder = F.when(name.isNotNull(), F.concat(F.lit(destination.rstrip("/") + "/"), name))
    return selected.select(F.lit(action).alias("action"), folder.alias("dest_dir"), "file_path", "seq", F.when(name.isNull(), "no folder name").alias("error"))


def unique_targets(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``target`` to a plan; ``existing`` is (dest_dir, name) of what is there already.

    Names meet only if they are equal without their " (n)" parts, so a destination is settled in as many
    groups as it has such names. Rows without a destination are left out.
    """

    def give(key: tuple, wanted: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        taken = set(there["name"])
        counters: dict[str, int] = {}
        targets = []
        wanted = wanted.sort_values(["seq", "file_path"], kind="stable")
        for name in wanted["name"]:
            stem, ext = os.path.splitext(name)
            made, n = name, counters.get(name, 0)
            while made in taken:
                n += 1
                made = f"{stem} ({n}){ext}"
            counters[name] = n
            taken.add(made)
            targets.append(f"{key[0].rstrip('/')}/{made}")
        return wanted[["action", "dest_dir", "file_path", "seq"]].assign(target=targets)

    keyed = lambda df: df.withColumn("key", F.regexp_replace("name", r" \(\d+\)", ""))
    clean = keyed(plan.where("dest_dir is not null").select("action", "dest_dir", "file_path", F.col("seq").cast("long").alias("seq"), paths.file_name("file_path").alias("name")))
    names = keyed(existing.select("dest_dir", "name").distinct())
    ddl = "action string, dest_dir string, file_path string, seq long, target string"
    return clean.groupBy("dest_dir", "key").cogroup(names.groupBy("dest_dir", "key")).applyInPandas(lambda key, a, b: give(key, a, b) if len(a) else pd.DataFrame(columns=["action", "dest_dir", "file_path", "seq", "target"]), ddl)


def existing_names(plan: DataFrame) -> DataFrame:
    """(dest_dir, name) of all that stands in a plan's destinations, listed where the tasks run."""

    def names(batches):
        for rows in batches:
            found = [(d, n) for d in rows["dest_dir"] if os.path.isdir(d) for n in os.listdir(d)]
            yield pd.DataFrame(found, columns=["dest_dir", "name"])

    return plan.where("dest_dir is not null").select("dest_dir").distinct().mapInPandas(names, "dest_dir string, name string")


def delete_plan(selected: DataFrame, permanent: bool = False, trash: str | None = None) -> DataFrame:
    """Delete rows; not permanent means a move into the trash folder."""
    if not permanent and not trash:
        raise ValueError("a trash folder is needed unless deletion is permanent")
    return selected.select(F.lit("Delete" if permanent else "Recycle").alias("action"), F.lit(None if permanent else trash).cast("string").alias("dest_dir"), "file_path", "seq")


def _identity(path: str) -> str | None:
    """Device, number, size and time of change of a file; null where there is none."""
    try:
        s = os.stat(path)
        return f"{s.st_dev}:{s.st_ino}:{s.st_size}:{s.st_mtime_ns}" if os.path.isfile(path) else None
    except OSError:
        return None


def _same(was: str | None, path: str | None) -> bool:
    """Whether a path holds the file of an earlier identity, or a copy of it with its size and time."""
    now = _identity(path) if path else None
    return bool(was and now) and (was == now or was.split(":")[2:] == now.split(":")[2:])


def _link(source: str, target: str) -> bool:
    """Make the target another name of the source; false where the file systems cannot. An error if it exists."""
    try:
        os.link(source, target)
    except OSError as e:
        if e.errno in (errno.EXDEV, errno.EPERM, errno.ENOTSUP, errno.EOPNOTSUPP, errno.EMLINK, errno.ENOSYS):
            return False
        raise
    return True


def _copy(source: str, target: str) -> None:
    """A copy with times that appears whole or not at all where links are known; an error if the target exists."""
    if os.path.lexists(target):
        raise FileExistsError(errno.EEXIST, "there is such a file already", target)
    part = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}.part")
    try:
        shutil.copy2(source, part)
        if not _link(part, target):
            os.close(os.open(target, os.O_CREAT | os.O_EXCL | os.O_WRONLY))  # the name is ours from here on
            os.replace(part, target)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(part)


def _act(action: str, source: str, target: str | None, was: str | None) -> None:
    """One action; repeating it changes nothing more. Errors are OSErrors."""
    if was is None:
        raise FileNotFoundError(errno.ENOENT, "no such file", source)
    if action not in _PLACING:
        with contextlib.suppress(FileNotFoundError):  # gone since it was seen: by an earlier attempt
            os.remove(source)
        return
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if os.path.lexists(target):
        if not _same(was, target):
            raise FileExistsError(errno.EEXIST, "there is such a file already", target)
    elif action == "Copy" or not _link(source, target):
        _copy(source, target)
    if action != "Copy" and _identity(source) == was:
        with contextlib.suppress(FileNotFoundError):
            os.remove(source)


def execute(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """One result row for each planned row: (action, file_path, target, ok, error). Failures are rows, not errors.

    A dry run touches nothing and stays lazy. A real run acts once, when it is called, and returns the written
    result. Targets are given here by ``unique_targets`` against what the destinations hold, unless the plan has
    them; one that exists by then, or that two rows share, is a failure. Files are listed and acted on where the
    tasks run, so a real run is for folders that all executors mount. Rows with an error in the plan keep it.
    """
    planned = plan if "error" in plan.columns else plan.withColumn("error", F.lit(None).cast("string"))
    if "target" not in plan.columns:
        placed = planned.where("error is null").where(F.col("action").isin(*_PLACING)) if "dest_dir" in plan.columns else None
        if placed is None:
            planned = planned.withColumn("target", F.lit(None).cast("string"))
        else:
            given = unique_targets(placed, existing_names(placed)).withColumn("error", F.lit(None).cast("string"))
            rest = planned.where(F.col("error").isNotNull() | ~F.col("action").isin(*_PLACING) | F.col("dest_dir").isNull()).withColumn("target", F.lit(None).cast("string"))
            columns = ["action", "file_path", "target", "error"]
            planned = given.select(*columns).unionByName(rest.select(*columns))
    rows = planned.select("action", "file_path", F.col("target").cast("string").alias("target"), F.col("error").cast("string").alias("error"))

    def looked_at(batches):
        for rows in batches:
            yield rows.assign(was=[_identity(p) for p in rows["file_path"]], there=[bool(t) and os.path.lexists(t) for t in rows["target"]])

    seen = rows.mapInPandas(looked_at, "action string, file_path string, target string, error string, was string, there boolean")
    if not dry_run:
        seen = materialise(seen, "actions")
    uses = seen.where("target is not null").groupBy("target").agg(F.count(F.lit(1)).alias("uses"))
    shared = F.when(F.col("uses") > 1, "two rows have this target")
    placing = F.col("action").isin(*_PLACING)
    why = F.coalesce("error", F.when(placing & F.col("target").isNull(), "no target"), shared, F.when(F.col("was").isNull(), "no such file"), F.when(F.col("there"), "there is such a file already"))
    judged = seen.join(uses, "target", "left").select("action", "file_path", "target", why.alias("error"), "was")
    if dry_run:
        return judged.select("action", "file_path", "target", F.col("error").isNull().alias("ok"), "error")

    def act(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                error = r.error
                if error is None:
                    try:
                        _act(r.action, r.file_path, r.target, r.was)
                    except OSError as e:
                        error = e.strerror or str(e)
                out.append((r.action, r.file_path, r.target, error is None, error))
            yield pd.DataFrame(out, columns=["action", "file_path", "target", "ok", "error"])

    done = materialise(judged.mapInPandas(act, _RESULT), "done")
    discard(seen)
    return done


def fold(results: DataFrame) -> DataFrame:
    """One row about a run: counts, and whether anything or nothing failed."""
    good, bad = F.count_if("ok"), F.count_if(~F.col("ok"))
    return results.agg(good.alias("succeeded"), bad.alias("failed"), F.count(F.lit(1)).alias("total"), (bad > 0).alias("has_failures"), ((bad == 0) & (good > 0)).alias("all_succeeded"))


def succeeded_paths(results: DataFrame) -> DataFrame:
    return results.where("ok").select("file_path")


def output_extension(output_format: Column | str) -> Column:
    """File extension of an output format; PNG for unknown ones."""
    f = F.col(output_format) if isinstance(output_format, str) else output_format
    return F.when(f == "JPEG", ".jpg").when(f == "BMP", ".bmp").when(f == "TIFF", ".tiff").when(f == "WebP", ".webp").otherwise(".png")
