"""The feature table, the manifest of scans, and the media source."""

import os
import struct
import uuid
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from twinweave.config import CLIP, Settings
from twinweave.operators import media as media_rows
from twinweave.operators.feature_store import FeatureStore
from twinweave.operators.manifest import Manifest, compared, snapshot
from twinweave.sources import files, media_source
from twinweave.sources.media_source import MediaReader, header, walked

T = [datetime(2024, 1, 1, 0, k) for k in range(10)]


def listing(spark, *rows):
    return spark.createDataFrame(list(rows), "file_path string, file_size long, modified_at timestamp")


# --- features by fingerprint


def counting(asked):
    def derive(fresh):
        asked.append(sorted(r["file_path"] for r in fresh.collect()))
        return fresh.withColumn("features", F.when(F.col("file_size") > 0, F.array(F.col("file_size").cast("float"), F.lit(1.0))))

    return derive


def test_what_is_stale_is_computed_and_nothing_else(spark, tmp_path):
    store, asked = FeatureStore(spark, str(tmp_path / "store")), []
    rows = [("/a/1.png", 10, T[0]), ("/a/2.png", 20, T[0]), ("/a/3.png", 0, T[0]), ("/A/1.PNG", 10, T[0]), ("/a/4.png", None, None)]
    held = listing(spark, *rows)
    done = store.update(held, counting(asked), Settings())
    assert (done.computed, done.batch) == (4, 0) and len(asked[-1]) == 4  # two spellings of one path are one file
    got = {r["file_path"]: r["features"] for r in store.featured(held, Settings()).collect()}
    assert got == {"/a/1.png": [10.0, 1.0], "/A/1.PNG": [10.0, 1.0], "/a/2.png": [20.0, 1.0]}

    # another threshold, batch size or parallelism: nothing is stale
    for same in (Settings(threshold=0.9), Settings(batch_size=3), Settings(parallelism=1), Settings(auto_analyse=False)):
        assert store.update(held, counting(asked), same) == type(done)(0, None)
    # one changed file: one row, and the former is no longer current
    changed = listing(spark, *[(p, s, T[5] if p == "/a/2.png" else t) for p, s, t in rows])
    assert store.update(changed, counting(asked), Settings()).computed == 1 and asked[-1] == ["/a/2.png"]
    assert {r["file_path"]: r["batch"] for r in store.featured(changed, Settings()).collect()} == {"/a/1.png": 0, "/A/1.PNG": 0, "/a/2.png": 1}
    # another layout, normalisation, model or size: all are
    for other in (Settings(layout="NHWC"), Settings(normalisation=CLIP), Settings(use_bundled_model=False, model_path="/m.onnx"), Settings(size=64)):
        assert store.stale(changed, other).count() == 4
    assert store.update(changed, counting(asked), Settings(layout="NHWC")).computed == 4
    assert store.stale(changed, Settings()).count() == 0  # and going back finds the former rows
    assert store.update(held.limit(0), counting(asked), Settings()).batch is None


def test_half_a_batch_is_not_seen(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "store"))
    held = listing(spark, ("/a/1.png", 10, T[0]))
    store.update(held, counting([]), Settings())
    os.remove(tmp_path / "store" / f"digest={Settings().features_digest()}" / "batch=0" / "_SUCCESS")
    assert store.stored(Settings()).count() == 0 and store.stale(held, Settings()).count() == 1
    with pytest.raises(Exception, match="(?i)exist"):  # whoever writes the same batch first has it
        store.update(held, counting([]), Settings())


# --- re-scans


def test_rescan_of_an_overlapping_root_equals_a_scan_from_nothing(spark, tmp_path):
    both = Manifest(spark, str(tmp_path / "m"))
    b = listing(spark, ("/lib/sub/x.png", 5, T[0]), ("/lib/SUB/y.png", 6, T[0]), ("/other/z.png", 7, T[0]))
    both.rescan("/lib", listing(spark, ("/lib/a.png", 1, T[0]), ("/lib/b.png", 2, T[0]), ("/lib/sub/X.png", 5, T[0]), ("/lib/sub/y.png", 6, T[0])))
    both.rescan("/lib/sub", b)
    a = listing(spark, ("/lib/b.png", 3, T[1]), ("/lib/c.png", 4, T[2]), ("/lib/sub/X.png", 5, T[0]), ("/lib/new.png", None, None), (None, 1, T[0]))
    n = both.rescan("/LIB", a)
    assert sorted(map(tuple, both.changes(n).collect())) == [("/lib/a.png", "gone", 1, None), ("/lib/b.png", "changed", 2, 3), ("/lib/c.png", "added", None, 4), ("/lib/new.png", "added", None, None), ("/lib/sub/y.png", "gone", 6, None)]

    fresh = Manifest(spark, str(tmp_path / "n"))
    fresh.rescan("/lib/sub", b)
    fresh.rescan("/lib", a)
    rows = lambda m: sorted(map(str, (r[:4] for r in map(tuple, m.media().collect()))))
    assert rows(both) == rows(fresh)
    held = {r["file_path"]: r["root"] for r in both.media().collect()}
    assert held == {"/lib/b.png": "/lib", "/lib/c.png": "/lib", "/lib/new.png": "/lib", "/lib/sub/x.png": "/lib/sub", "/lib/SUB/y.png": "/lib/sub", "/other/z.png": "/lib/sub"}
    bridge = media_rows.provenance(both.listing())
    assert sorted(r["root_key"] for r in bridge.where("path_key = '/lib/sub/x.png'").collect()) == ["/lib", "/lib/sub"]

    both.remove("/lib/sub")
    assert {r["file_path"] for r in both.media().collect()} == {"/lib/b.png", "/lib/c.png", "/lib/new.png", "/lib/sub/X.png"}
    assert both.changes(4).where("change = 'gone'").count() == 3
    n = both.rescan("/lib/sub", b)
    assert both.changes(n).where("change = 'added'").count() == 3 and both.media().count() == 6


def test_comparison_of_random_snapshots(spark):
    import random

    rng = random.Random(6)
    for _ in range(3):
        sides = [{f"/{k}.png": (rng.randrange(3) or None, rng.choice([*T[:3], None])) for k in range(60) if rng.random() < 0.7} for _ in range(2)]
        frames = [snapshot(listing(spark, *[(p.upper() if i else p, *v) for p, v in s.items()])) for i, s in enumerate(sides)]
        want = {p: "added" if p not in sides[0] else "gone" if p not in sides[1] else "changed" for p in {**sides[0], **sides[1]} if sides[0].get(p, "none") != sides[1].get(p, "none")}
        assert {r["path_key"]: r["change"] for r in compared(*frames).collect()} == want
    assert compared(frames[0].limit(0), frames[1].limit(0)).count() == 0


# --- the source


def png(w, h):
    body = struct.pack(">II5B", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body))


def jpeg(w, h, before=0):
    filler = b"".join(b"\xff\xe2" + struct.pack(">H", min(60_000, before - k) + 2) + b"\0" * min(60_000, before - k) for k in range(0, before, 60_000))
    return b"\xff\xd8" + filler + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9 + b"\xff\xd9"


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "lib"
    for k in range(9):
        (root / f"d{k % 3}" / f"e{k}").mkdir(parents=True)
        (root / f"d{k % 3}" / f"e{k}" / f"p{k}.PNG").write_bytes(png(100 + k, 50) + b"\0" * 20_000)
    (root / "top.jpg").write_bytes(jpeg(640, 480, 300_000) + b"\1" * 900_000)
    (root / "near.jpeg").write_bytes(jpeg(64, 48))
    (root / "bad.gif").write_bytes(b"no picture" * 3000)
    (root / "cut.png").write_bytes(png(3, 4)[:18])
    (root / "empty.bmp").write_bytes(b"")
    (root / "film.mp4").write_bytes(b"film")
    (root / "note.txt").write_bytes(b"note")
    return root


def test_source_lists_what_scan_lists(spark, folder):
    media_source.register(spark)
    read = lambda **o: spark.read.format("media_files").options(**o).load(str(folder))
    for kinds in ("image", "video", "media"):
        for deep in (True, False):
            want = {(r["file_path"], r["file_size"], r["modified_at"].replace(microsecond=0)) for r in files.scan(spark, [files.ScanRoot(str(folder), deep)], kinds).collect()}
            got = {(r["file_path"], r["file_size"], r["modified_at"].replace(microsecond=0)) for r in read(kinds=kinds, recursive=str(deep)).collect()}
            # the file reader of Spark gives no row for an empty file
            assert {r for r in got if r[1]} == want and want and sum(not r[1] for r in got) == (kinds != "video")
    assert read().rdd.getNumPartitions() == 13  # one for each folder
    assert read().agg(F.sum("bytes_read")).first()[0] == 0


def test_filters_reach_the_source(spark, folder):
    media_source.register(spark)
    frame = spark.read.format("media_files").option("headers", "true").load(str(folder))
    one = frame.where("extension = '.jpeg' and width > 1")
    assert [(r["width"], r["height"]) for r in one.collect()] == [(64, 48)]
    reader = MediaReader(str(folder), "image", True, False)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([In(("extension",), (".png", ".txt")), EqualTo(("file_path",), "x"), GreaterThan(("width",), 3)]))
    assert reader.wanted == (".png",) and len(left) == 2
    assert {os.path.basename(r[0]) for p in reader.partitions() for r in reader.read(p)} == {"cut.png", *(f"p{k}.PNG" for k in range(9))}
    assert frame.where("extension in ('.gif', '.bmp')").count() == 2 and frame.where("extension = '.txt'").count() == 0


def test_headers_read_what_they_need(folder, spark):
    media_source.register(spark)
    rows = {os.path.basename(r["file_path"]): r for r in spark.read.format("media_files").option("headers", "true").load(str(folder)).collect()}
    assert all((rows[f"p{k}.PNG"]["width"], rows[f"p{k}.PNG"]["bytes_read"]) == (100 + k, 4096) for k in range(9))
    far = rows["top.jpg"]
    assert (far["width"], far["height"]) == (640, 480) and 300_000 < far["bytes_read"] < 400_000
    assert (rows["near.jpeg"]["width"], rows["near.jpeg"]["bytes_read"]) == (64, rows["near.jpeg"]["file_size"])
    for name, most in (("bad.gif", 4096), ("cut.png", 18), ("empty.bmp", 0)):
        assert rows[name]["width"] is None and rows[name]["error"] and rows[name]["bytes_read"] == most
    assert header(str(folder / "gone.png"))[3].startswith("FileNotFoundError")


def test_a_refused_folder_leaves_the_top(folder, monkeypatch):
    assert len(walked(str(folder), True)) == 13 and walked(str(folder), False) == [str(folder)]
    real = os.scandir

    def refusing(path):
        if path in refused:
            raise PermissionError(13, "x", path)  # no word of the message counts
        return real(path)

    monkeypatch.setattr(os, "scandir", refusing)
    refused = {str(folder / "d1")}
    reader = MediaReader(str(folder), "image", True, False)
    assert {os.path.basename(r[0]) for p in reader.partitions() for r in reader.read(p)} == {"top.jpg", "near.jpeg", "bad.gif", "cut.png", "empty.bmp"}
    refused = {str(folder)}
    with pytest.raises(PermissionError):
        reader.partitions()
    with pytest.raises(FileNotFoundError):
        walked(str(folder / uuid.uuid4().hex), True)


class _Cause:
    """A Java error of a class, with what it comes from."""

    def __init__(self, name, cause=None):
        self.name, self.cause = name, cause

    def getClass(self):  # noqa: N802
        return self

    def getName(self):  # noqa: N802
        return self.name

    def getCause(self):  # noqa: N802
        return self.cause


def test_a_refusal_is_known_by_its_class():
    def error(*names):
        cause = None
        for n in reversed(names):
            cause = _Cause(n, cause)
        made = Exception("permission denied")
        made._origin = cause
        return made

    assert files.refused(error("org.apache.spark.SparkException", "org.apache.hadoop.security.AccessControlException"))
    assert files.refused(error("java.nio.file.AccessDeniedException"))
    assert not files.refused(error("java.io.IOException")) and not files.refused(Exception("denied"))


def test_a_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)not.*exist"):
        files.scan(spark, [files.ScanRoot(str(tmp_path / "none"), True)]).count()
