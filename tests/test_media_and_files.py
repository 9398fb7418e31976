"""Files end to end: scan, headers, kernels, embedding, actions and the stream."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinweave.config import IMAGENET, Settings
from twinweave.operators import actions, features, imaging
from twinweave.plans.finder import DuplicateFinder
from twinweave.sources import files, images, videos
from twinweave.streaming import ingest


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bmp(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    rows = b"".join(row[:, ::-1].tobytes() + bytes(-3 * w % 4) for row in pixels[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def framed(w, h, left=0, top=0, right=0, bottom=0, inner=(200, 100, 50), edge=(0, 0, 0)):
    out = np.zeros((h, w, 3), np.uint8)
    out[:] = edge
    out[top : h - bottom, left : w - right] = inner
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    (root / "deep").mkdir()
    rng = np.random.default_rng(1)
    for i in range(4):
        (root / f"img{i}.png").write_bytes(png(rng.integers(0, 256, (30 + i, 40, 3), dtype=np.uint8)))
    (root / "deep" / "Copy.BMP").write_bytes(bmp(framed(60, 50, 10, 10, 10, 10)))
    (root / "broken.png").write_bytes(b"not a picture")
    (root / "note.txt").write_text("text")
    return root


@pytest.mark.parametrize(
    "args,tolerance,want",
    [
        (dict(w=100, h=60, top=10, bottom=10), 80, (0, 10, 100, 40)),
        (dict(w=100, h=60, top=20, bottom=5), 80, (0, 20, 100, 35)),
        (dict(w=100, h=60, left=15, right=15), 80, (15, 0, 70, 60)),
        (dict(w=100, h=100, left=12, top=12, right=12, bottom=12), 80, (12, 12, 76, 76)),
        (dict(w=50, h=50), 80, (0, 0, 50, 50)),
        (dict(w=300, h=300, left=1, top=1, right=1, bottom=1), 80, (0, 0, 300, 300)),
        (dict(w=300, h=300, left=3, top=3, right=3, bottom=3), 80, (3, 3, 294, 294)),
        (dict(w=19, h=40, left=5, top=5, right=5, bottom=5), 80, (0, 0, 19, 40)),
        (dict(w=100, h=60, top=10, bottom=10), 250, (0, 0, 100, 60)),
        (dict(w=100, h=60, top=10, bottom=10, inner=(40, 40, 40)), 30, (0, 10, 100, 40)),
        (dict(w=100, h=60, top=10, bottom=10, inner=(40, 40, 40)), 80, (0, 0, 100, 60)),
        (dict(w=100, h=60, top=26, bottom=26), 80, (0, 0, 100, 60)),
    ],
)
def test_borders(args, tolerance, want):
    assert imaging.borders(framed(**args), tolerance) == want


def test_orientations_undo_each_other():
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    for o, back in {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 8, 7: 7, 8: 6}.items():
        assert np.array_equal(imaging.orient(imaging.orient(pixels, o), back), pixels)


def test_resampling_keeps_constants_and_sizes():
    flat = np.full((33, 50, 3), 77, np.uint8)
    for method in ("NearestNeighbor", "Bilinear", "Bicubic", "Lanczos", "MitchellNetravali"):
        for w, h in ((20, 10), (90, 70)):
            out = imaging.resample(flat, w, h, method)
            assert out.shape == (h, w, 3) and (out == 77).all()
    for how in ("Crop", "Padding", "Stretch"):
        assert imaging.resize(flat, Settings(size=32, resize_method=how)).shape == (32, 32, 3)
    padded = imaging.resize(flat, Settings(size=32, resize_method="Padding"))
    assert (padded[0] == 255).all() and (padded[16] == 77).all()


def test_scan_finds_images_once(spark, folder):
    roots = files.add_root([files.ScanRoot(str(folder))], files.ScanRoot(str(folder / "deep")))
    with pytest.raises(ValueError):
        files.add_root(roots, files.ScanRoot(str(folder).upper()))
    listed = files.scan(spark, roots)
    assert listed.count() == 7
    media = files.media_from_listing(listed)
    assert sorted(r["file_name"] for r in media.collect()) == ["Copy.BMP", "broken.png", "img0.png", "img1.png", "img2.png", "img3.png"]
    assert files.scan(spark, [files.ScanRoot(str(folder), recursive=False)]).count() == 5
    assert files.scan(spark, []).count() == 0
    assert files.with_file_times(media).where("stat_size > 0 and created_at is not null").count() == 6


def test_headers(spark, folder):
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder)).where("path not like '%.txt'")
    got = {os.path.basename(r["path"]): r for r in images.metadata(rows).collect()}
    assert (got["img2.png"]["width"], got["img2.png"]["height"]) == (40, 32)
    assert (got["Copy.BMP"]["width"], got["Copy.BMP"]["height"]) == (60, 50)
    assert got["broken.png"]["error"] and got["broken.png"]["width"] is None


def test_exif():
    def tiff(entries):
        body, extra = b"", b""
        base = 8 + 2 + 12 * len(entries) + 4
        for tag, kind, n, raw in entries:
            if len(raw) <= 4:
                value = raw + bytes(4 - len(raw))
            else:
                value = struct.pack("<I", base + len(extra))
                extra += raw
            body += struct.pack("<HHI", tag, kind, n) + value
        return b"II*\0" + struct.pack("<IH", 8, len(entries)) + body + bytes(4) + extra

    data = tiff([(0x010F, 2, 6, b"Maker\0"), (0x0110, 2, 3, b"  \0"), (0x0112, 3, 1, struct.pack("<H", 6)), (0x829A, 5, 1, struct.pack("<II", 1, 250)), (0x8827, 3, 1, struct.pack("<H", 400))])
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(data) + 8) + b"Exif\0\0" + data + b"\xff\xc0" + struct.pack(">HBHH", 8, 8, 33, 44) + b"\x01\xff\xda"
    got = images.read_metadata(jpeg)
    assert (got["width"], got["height"], got["camera_make"], got["camera_model"], got["orientation"], got["iso"]) == (44, 33, "Maker", None, 6, 400)
    assert got["exposure_seconds"] == pytest.approx(0.004)


def tiff(pixels, packing=1, predictor=1):
    h, w, n = pixels.shape
    raw = np.concatenate([pixels[:, :1], np.diff(pixels, axis=1)], axis=1) if predictor == 2 else pixels
    body = {1: bytes, 8: zlib.compress, 32773: lambda b: b"".join(bytes([len(c) - 1]) + c for c in (b[i : i + 128] for i in range(0, len(b), 128)))}[packing](raw.astype(np.uint8).tobytes())
    entries = [(0x100, 3, 1, w), (0x101, 3, 1, h), (0x102, 3, 1, 8), (0x103, 3, 1, packing), (0x106, 3, 1, 2 if n > 1 else 1), (0x111, 4, 1, 8), (0x115, 3, 1, n), (0x116, 3, 1, h), (0x117, 4, 1, len(body)), (0x13D, 3, 1, predictor)]
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + bytes(4)


@pytest.mark.parametrize("packing,predictor,samples", [(1, 1, 3), (8, 1, 3), (8, 2, 3), (32773, 1, 3), (1, 1, 1), (8, 2, 4)])
def test_tiff_pixels(packing, predictor, samples):
    pixels = np.random.default_rng(2).integers(0, 256, (13, 17, samples), dtype=np.uint8)
    want = np.repeat(pixels, 3, axis=2) if samples == 1 else pixels[:, :, :3]
    assert np.array_equal(images.decode_tiff(tiff(pixels, packing, predictor)), want)


def test_every_file_is_decoded_or_failed(spark, tmp_path):
    pixels = np.random.default_rng(3).integers(0, 256, (12, 15, 3), dtype=np.uint8)
    for name, data in {"a.png": png(pixels), "b.tif": tiff(pixels, 8, 2), "c.png": b"broken", "d.tiff": b"II*\0" + bytes(20), "e.webp": b"RIFF0000WEBPVP8 ", "f.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {os.path.basename(r["path"]): r for r in images.decoded_or_failed(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a.png", "b.tif", "c.png", "d.tiff", "e.webp"]
    assert [n for n, r in rows.items() if r["error"] is None and r["image"] is not None] and {n for n, r in rows.items() if r["error"]} == {"c.png", "d.tiff", "e.webp"}
    for n in ("a.png", "b.tif"):
        im = rows[n]["image"]
        assert np.array_equal(imaging.from_image_struct(im["height"], im["width"], im["nChannels"], im["data"]), pixels)


def test_resolution_by_the_header():
    assert images.properties(bmp(framed(4, 4)))["dpi_x"] == pytest.approx(2835 * 0.0254)
    jfif = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1\1" + struct.pack(">HH", 300, 150) + b"\0\0" + b"\xff\xc0" + struct.pack(">HBHH", 8, 8, 33, 44) + b"\x01\xff\xda"
    got = images.properties(jfif)
    assert (got["dpi_x"], got["dpi_y"], got["width"]) == (300.0, 150.0, 44)


def test_depth_of_a_scan(spark, tmp_path):
    (tmp_path / "flat").mkdir()
    (tmp_path / "deep" / "in").mkdir(parents=True)
    assert not files.ScanRoot(str(tmp_path / "flat")).deep and files.ScanRoot(str(tmp_path / "deep")).deep
    assert not files.ScanRoot(str(tmp_path / "deep"), recursive=False).deep


def test_videos(spark):
    raw = spark.createDataFrame([("/v.mp4", 61.5, 25000, 4, 3, 1500000, 0, 0, "", "", "", 0, 2)], videos.RAW)
    row = videos.derive(raw).first()
    assert (row["frame_rate"], row["has_audio"], row["total_frames"], row["duration_text"]) == (25.0, False, 1537, "1:01")


class MeanColour:
    """A stand-in for a model: the mean of each channel."""

    def embed(self, items):
        def run(batches):
            import pandas as pd

            for rows in batches:
                yield pd.DataFrame({"item_idx": rows["item_idx"], "features": [None if p is None else (np.frombuffer(p, np.uint8).reshape(-1, 3).mean(axis=0) / 255).astype(np.float32) for p in rows["pixels"]]})

        return items.select("item_idx", "pixels").mapInPandas(run, "item_idx long, features array<float>")


def test_images_to_groups_to_plan(spark, folder):
    decoded = images.decoded(spark, str(folder / "*.png")).withColumn("item_idx", F.regexp_extract("image.origin", r"img(\d)", 1).cast("long"))
    finder = DuplicateFinder(spark, Settings(size=32, threshold=0.9), constrained=False)
    made = finder.features(decoded, MeanColour())
    assert imaging.outcome(imaging.preprocess(decoded, finder.settings)).first()["succeeded"] == 4
    items = made.withColumn("source_id", F.col("item_idx").cast("string")).withColumns({"file_path": F.concat(F.lit(str(folder) + "/img"), F.col("item_idx"), F.lit(".png")), "file_size": F.lit(1), "pixels": F.col("item_idx"), "created_at": F.lit(None).cast("timestamp"), "modified_at": F.lit(None).cast("timestamp")})
    head, found, members = finder.analyse(items)
    assert head.first()["duplicate_groups"] == 1
    chosen = finder.select(members, items, "KeepHighestResolution")
    plan = finder.plan(chosen, finder.view(found), "/dest", "Copy", grouped=True)
    rows = plan.collect()
    assert len(rows) == 3 and all(r["dest_dir"] == "/dest/Group 1" for r in rows)
    assert not any(r["file_path"].endswith("img3.png") for r in rows)


def test_actions_need_to_be_told(spark, tmp_path):
    for n in ("a.jpg", "b.jpg"):
        (tmp_path / n).write_text(n)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.jpg").write_text("old")
    rows = spark.createDataFrame([(str(tmp_path / "a.jpg"), 0), (str(tmp_path / "gone.jpg"), 1), (str(tmp_path / "b.jpg"), 2)], "file_path string, seq long")
    plan = actions.unique_targets(actions.flat_plan(rows, str(tmp_path / "out"), "Move"), spark.createDataFrame([(str(tmp_path / "out"), "a.jpg")], "dest_dir string, name string"))
    dry = actions.fold(actions.execute(plan)).first()
    assert (dry["succeeded"], dry["failed"]) == (2, 1) and (tmp_path / "a.jpg").exists()
    done = actions.execute(plan, dry_run=False).collect()
    assert sorted(os.listdir(tmp_path / "out")) == ["a (1).jpg", "a.jpg", "b.jpg"]
    assert [r["error"] for r in done if not r["ok"]] == ["no such file"]
    assert actions.flat_plan(rows, "", "Move").count() == 0
    with pytest.raises(ValueError):
        actions.delete_plan(rows)


def test_unique_targets_follow_order(spark):
    rows = spark.createDataFrame([("/x/a.jpg", 0), ("/y/a.jpg", 1), ("/x/b.jpg", 2)], "file_path string, seq long")
    there = spark.createDataFrame([("/d", "a.jpg"), ("/d", "a (1).jpg")], "dest_dir string, name string")
    got = {r["seq"]: r["target"] for r in actions.unique_targets(actions.flat_plan(rows, "/d"), there).collect()}
    assert got == {0: "/d/a (2).jpg", 1: "/d/a (3).jpg", 2: "/d/b.jpg"}


def test_inference_retries_and_pads():
    calls = []

    def run(batch):
        calls.append(len(batch))
        if len(batch) > 1 and batch[:, 0].min() < 0:
            raise RuntimeError("bad batch")
        if batch[0, 0] < 0:
            raise RuntimeError("bad image")
        return batch * 2

    good = features.infer(run, np.ones((2, 3)), insists=4)
    assert calls == [4] and len(good) == 2
    mixed = features.infer(run, np.array([[1.0], [-1.0], [2.0]]))
    assert mixed[1] is None and mixed[2][0] == 4.0
    x = features.tensor(np.full((1, 2, 2, 3), 255, np.uint8), IMAGENET)
    assert x.shape == (1, 3, 2, 2) and x[0, 0, 0, 0] == pytest.approx((1 - 0.485) / 0.229, rel=1e-5)


def test_stream_keeps_features(spark, folder, tmp_path):
    table = str(tmp_path / "features")
    query = ingest.keep_features(ingest.stream_files(spark, str(folder)), lambda rows: rows.select("path", "length"), table, str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(table).count() == 6


def test_images_are_handed_on_in_parts_of_bounded_size(spark, monkeypatch):
    """A batch of many images is not held as a whole by what is made of it."""
    from twinweave.operators import imaging

    frames = list(imaging.in_parts(((i, bytes(1 << 20), None) for i in range(40)), ["item_idx", "pixels", "error"]))
    assert [len(f) for f in frames] == [8] * 5 and [*frames[4]["item_idx"]] == [*range(32, 40)]
    assert list(imaging.in_parts([], ["item_idx"])) == []
    seen = []
    monkeypatch.setattr(type(spark.range(0)), "mapInPandas", lambda self, run, ddl: seen.append(run))
    rows = spark.createDataFrame([(0, (2, 2, 3, bytes(12)))], "item_idx long, image struct<height:int,width:int,nChannels:int,data:binary>")
    imaging.preprocess(rows, imaging.Settings(size=320))
    import pandas as pd

    batch = pd.DataFrame([(i, 2, 2, 3, bytes(12), 1) for i in range(100)], columns=["item_idx", "height", "width", "channels", "data", "orientation"])
    parts = list(seen[0](iter([batch])))
    assert len(parts) > 3 and sum(map(len, parts)) == 100
    assert max(p["pixels"].map(len).sum() for p in parts) <= imaging.PART_BYTES + 320 * 320 * 3
