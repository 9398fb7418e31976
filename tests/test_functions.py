"""Golden tables of scalar functions."""

import pytest
from pyspark.sql import functions as F

from twinweave.config import CLIP, Settings
from twinweave.functions import display, paths, vectors


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("__zero")).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a,b,want", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-2.0, 0.0], -1.0), ([3.0, 4.0], [4.0, 3.0], 0.96), ([0.0, 0.0], [1.0, 2.0], 0.0), ([], [], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert df.select(vectors.cosine("a", "b").alias("v")).first()["v"] == pytest.approx(want)


@pytest.mark.parametrize("a,b", [([1.0], [1.0, 2.0]), (None, [1.0])])
def test_cosine_errors(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="vector"):
        df.select(vectors.cosine("a", "b")).collect()


NAMES = [("Group 1", True, "Group 1"), ("a/b:c", False, "a_b_c"), ("  x  ", True, "x"), ("trail...", False, "trail"), ("con", False, "con_"), ("COM10", True, "COM10"), ("...", False, None), ("a\tb", False, "ab"), ("a" * 300, False, "a" * 255)]


@pytest.mark.parametrize("name,valid,clean", NAMES)
def test_names(spark, name, valid, clean):
    row = spark.createDataFrame([(name,)], "n string").select(paths.is_valid_name("n").alias("v"), paths.sanitised_name("n").alias("s")).first()
    assert (row["v"], row["s"]) == (valid, clean)


@pytest.mark.parametrize("name", ["", "  ", None])
def test_blank_names_are_errors(spark, name):
    with pytest.raises(Exception, match="blank"):
        spark.createDataFrame([(name,)], "n string").select(paths.sanitised_name("n")).collect()


@pytest.mark.parametrize("size,text", [(0, "0 B"), (1023, "1,023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1048576, "1.0 MB"), (1024**5 * 3, "3.0 PB")])
def test_file_size(spark, size, text):
    assert one(spark, display.file_size_text("x"), x=size) == text


def test_display(spark):
    assert [one(spark, display.orientation("w", "h"), w=w, h=h) for w, h in ((3, 2), (2, 3), (2, 2), (0, 0))] == ["Landscape", "Portrait", "Square", "Square"]
    assert one(spark, display.aspect_ratio("w", "h"), w=4, h=0) == 0 and one(spark, display.aspect_ratio("w", "h"), w=16, h=8) == 2.0
    assert [one(spark, display.exposure_text(F.lit(x).cast("double"))) for x in (None, 2.0, 0.004, 0.3)] == ["", "2.0s", "1/250s", "1/3s"]
    assert [one(spark, display.flash_text("x"), x=x) for x in (0, 25, 2)] == ["No Flash", "Flash Fired, Auto", "Unknown (2)"]
    assert [one(spark, display.bitrate_text("x"), x=x) for x in (0, 128000, 1500000)] == ["", "128 kbps", "1.5 Mbps"]
    assert [one(spark, display.duration_text("x"), x=x) for x in (59, 3661, 90061)] == ["0:59", "1:01:01", "1:01:01"]
    assert [one(spark, display.channels_text("x"), x=x) for x in (0, 2, 9)] == ["No Audio", "Stereo", "9 channels"]
    assert one(spark, display.progress_text(F.lit("Processing"), F.lit(252), F.lit(1500))) == "Processing 252/1,500 (16.8%)"
    assert one(spark, display.summary_text(F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == "No items were analyzed."
    assert one(spark, display.summary_text(F.lit(9), F.lit(0), F.lit(0), F.lit(9))).startswith("No duplicate groups")


def test_extensions(spark):
    df = spark.createDataFrame([("a.JPG",), ("b.mkv",), ("c.onnx",), ("d.txt",), ("noext",)], "p string")
    assert [r["t"] for r in df.select(paths.media_type("p").alias("t")).collect()] == ["Image", "Video", None, None, None]
    with pytest.raises(Exception, match="unsupported"):
        df.select(paths.media_type("p", strict=True)).collect()


def test_settings():
    assert Settings(threshold=0.1).threshold == 0.3 and Settings(threshold=1.2).threshold == 1.0
    assert Settings(batch_size=100).batch_size == 64
    s = Settings()
    assert s.with_threshold(0.7505) is s and s.with_threshold(0.8).threshold == 0.8
    assert Settings.from_json(Settings(normalisation=CLIP, size=64).to_json()) == Settings(normalisation=CLIP, size=64)
    assert s.bundled_defaults().downsampling == "Bilinear"
    assert s.affects_features(Settings(layout="NHWC")) and not s.affects_features(Settings(size=100))
    with pytest.raises(ValueError):
        Settings(resize_method="Squash")


def test_texts_and_logs(spark, tmp_path):
    from twinweave.functions.texts import Texts
    from twinweave.logs import log_to

    texts = Texts([("a", "old"), ("a", "{0} of {1}"), ("b", "plain")])
    assert (texts("a", 1, 2), texts("b"), texts("missing")) == ("1 of 2", "plain", "")
    df = spark.createDataFrame([("b",), ("missing",)], "k string")
    assert [r["t"] for r in df.select(texts.column("k").alias("t")).collect()] == ["plain", ""]
    log = log_to(str(tmp_path))
    assert log_to(str(tmp_path)) is log and len(log.handlers) == 1
    log.info("hello")
    assert "hello" in (tmp_path / "twinweave.log").read_text()
