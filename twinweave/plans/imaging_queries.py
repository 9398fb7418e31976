"""Queries over made images, headers, tensors and states, with their DuckDB SQL.

No image files are among the tables, so images are made from the numbers of ``embeddings`` by arithmetic: framed
and plain ones for the kernels, PNG and JPEG bytes for the headers. The SQL says what the operators have to find
from the same numbers, without any pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.config import CLIP, Normalisation, Settings
from twinweave.functions import display, vectors
from twinweave.functions.texts import Texts
from twinweave.operators import clustering, features, groups, imaging, media
from twinweave.sources import images


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_idx"))


def _mapped(rows: DataFrame, make: Callable[[int], tuple], ddl: str) -> DataFrame:
    """A row of ``make(item)`` for every item."""
    names = [x.split()[0] for x in ddl.split(",")]

    def run(batches):
        for part in batches:
            yield pd.DataFrame([(int(i), *make(int(i))) for i in part["item_idx"]], columns=["item_idx", *names])

    return rows.select("item_idx").mapInPandas(run, "item_idx long, " + ddl)


def framed(i: int) -> np.ndarray:
    """An image with a frame: sides, depths and colours by the item's number."""
    w, h = 40 + i % 7 * 30, 36 + i % 5 * 40
    left = right = i % 4 * 3 if i % 3 else 0
    top, bottom = (i % 6 * 2, i % 5 * 3) if i % 2 else (0, 0)
    out = np.zeros((h, w, 3), np.uint8)
    out[:] = (i % 50, 10, 20)
    out[top : h - bottom, left : w - right] = (i % 50 + i % 4 * 60, 60, 80)
    return out


_FRAMED_SQL = """made AS (SELECT item_idx, 40 + item_idx % 7 * 30 AS w, 36 + item_idx % 5 * 40 AS h, CASE WHEN item_idx % 3 > 0 THEN item_idx % 4 * 3 ELSE 0 END AS side,
  CASE WHEN item_idx % 2 = 1 THEN item_idx % 6 * 2 ELSE 0 END AS top_, CASE WHEN item_idx % 2 = 1 THEN item_idx % 5 * 3 ELSE 0 END AS bottom_, greatest(60, item_idx % 4 * 60) AS apart
  FROM (SELECT vec_id AS item_idx FROM embeddings)),
seen AS (SELECT item_idx, w, h, CASE WHEN apart > 80 AND side >= greatest(2, least(w, h) // 100) THEN side ELSE 0 END AS l, CASE WHEN apart > 80 AND top_ >= greatest(2, least(w, h) // 100) THEN top_ ELSE 0 END AS t,
  CASE WHEN apart > 80 AND bottom_ >= greatest(2, least(w, h) // 100) THEN bottom_ ELSE 0 END AS b FROM made),
cut AS (SELECT item_idx, CASE WHEN ok THEN l ELSE 0 END AS x, CASE WHEN ok THEN t ELSE 0 END AS y, CASE WHEN ok THEN w - 2 * l ELSE w END AS width, CASE WHEN ok THEN h - t - b ELSE h END AS height
  FROM (SELECT *, w - 2 * l >= 10 AND h - t - b >= 10 AS ok FROM seen))"""


def image_borders(spark, sf_dir):
    return _mapped(_ids(spark, sf_dir), lambda i: imaging.borders(framed(i)), "x long, y long, width long, height long")


def image_crop(spark, sf_dir):
    """What is left after the borders: its size, and the colour of its middle."""

    def crop(i):
        out = imaging.crop_borders(framed(i))
        h, w = out.shape[:2]
        return w, h, int(out[h // 2, w // 2, 1])

    return _mapped(_ids(spark, sf_dir), crop, "width long, height long, green long")


def image_orient(spark, sf_dir):
    """Where the marked upper left pixel of a 3 by 2 image stands after each orientation."""

    def turn(i):
        pixels = np.zeros((2, 3, 3), np.uint8)
        pixels[0, 0] = 200
        out = imaging.orient(pixels, i % 10)
        y, x = np.argwhere(out[:, :, 0] == 200)[0]
        return out.shape[1], out.shape[0], int(x), int(y)

    return _mapped(_ids(spark, sf_dir), turn, "width long, height long, x long, y long")


def image_resize(spark, sf_dir):
    """Plain images brought to 40 by 40: the number of pixels in their own colour, and that colour."""

    def fit(i):
        w, h = 20 * (1 + i % 4), 20 * (1 + i % 3)
        how = ("Stretch", "Crop", "Padding")[i % 3 if i % 2 else i // 2 % 3]
        made = imaging.resize(np.full((h, w, 3), i % 200, np.uint8), Settings(size=40, resize_method=how, downsampling="Bicubic", upsampling="Bilinear"))
        own = (made == i % 200).all(axis=2)
        return how, made.shape[1], made.shape[0], int(own.sum()), int(made[20, 20, 2])

    return _mapped(_ids(spark, sf_dir), fit, "method string, width long, height long, own long, value long")


def _image_rows(spark, sf_dir):
    """Image structs as the source gives them; every seventh has too few bytes."""

    def made(batches):
        for part in batches:
            for i in part["item_idx"]:
                pixels = framed(int(i))
                data = pixels[:, :, ::-1].tobytes()
                yield i, pixels.shape[0], pixels.shape[1], 3, data[: len(data) // 2] if i % 7 == 0 else data

    def rows(batches):
        return imaging.in_parts(made(batches), ["item_idx", "height", "width", "nChannels", "data"])

    flat = _ids(spark, sf_dir).mapInPandas(rows, "item_idx long, height int, width int, nChannels int, data binary")
    return flat.select("item_idx", F.struct("height", "width", "nChannels", "data").alias("image"))


def image_preprocess(spark, sf_dir):
    """The whole chain without resizing: sizes after the crop, and which rows failed."""
    done = imaging.preprocess(_image_rows(spark, sf_dir), Settings(resize=False))
    return done.select("item_idx", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.coalesce(F.length("pixels"), F.lit(0)).cast("long").alias("n_bytes"), F.col("error").isNotNull().alias("failed"))


def image_outcome(spark, sf_dir):
    return imaging.outcome(imaging.preprocess(_image_rows(spark, sf_dir), Settings(size=32)))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_bytes(i: int) -> bytes:
    """The head of a PNG file of one of four pixel kinds, some with a resolution."""
    depth, colour = ((8, 2), (8, 0), (16, 6), (16, 0))[i % 4]
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", 100 + i % 50, 200 + i % 70, depth, colour, 0, 0, 0))
    physical = _chunk(b"pHYs", struct.pack(">IIB", 4000, 2000, 1)) if i % 3 == 0 else b""
    return b"\x89PNG\r\n\x1a\n" + head + physical + _chunk(b"IDAT", b"") + _chunk(b"IEND", b"")


def _files(spark, sf_dir, make: Callable[[int], bytes]) -> DataFrame:
    return _mapped(_ids(spark, sf_dir), lambda i: (str(i), make(i)), "path string, content binary").select("path", "content")


def png_headers(spark, sf_dir):
    """Size, resolution and pixel format by the header; every ninth file is broken."""
    rows = images.metadata(_files(spark, sf_dir, lambda i: b"no picture" if i % 9 == 0 else png_bytes(i)))
    return rows.select(F.col("path").cast("long").alias("item_idx"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.round("dpi_x", 6).alias("dpi_x"), F.round("dpi_y", 6).alias("dpi_y"), "pixel_format", "has_alpha", F.col("bits_per_pixel").cast("long").alias("bits"), F.col("error").isNotNull().alias("failed"))


def exif_bytes(i: int) -> bytes:
    """A JPEG's head with EXIF data: maker, orientation, exposure, sensitivity and a place."""
    extra = b""

    def block(entries: list, base: int) -> bytes:
        nonlocal extra
        body, extra = b"", b""
        at = base + 2 + 12 * len(entries) + 4
        for tag, kind, n, raw in entries:
            if len(raw) <= 4:
                raw_value = raw.ljust(4, b"\0")
            else:
                raw_value = struct.pack("<I", at + len(extra))
                extra += raw
            body += struct.pack("<HHI", tag, kind, n) + raw_value
        return struct.pack("<H", len(entries)) + body + bytes(4) + extra

    angle = lambda d, m: struct.pack("<6I", d, 1, m, 1, 30, 1)
    place = [(1, 2, 2, b"S\0" if i % 2 else b"N\0"), (2, 5, 3, angle(i % 80, i % 60)), (3, 2, 2, b"E\0"), (4, 5, 3, angle(i % 170, 15))]
    main = [(0x010F, 2, 6, b"Maker\0"), (0x0112, 3, 1, struct.pack("<H", i % 8 + 1)), (0x829A, 5, 1, struct.pack("<II", 1, 50 + i % 200)), (0x8827, 3, 1, struct.pack("<H", 100 * (1 + i % 30)))]
    with_place = main + [(0x8825, 4, 1, struct.pack("<I", 8 + len(block([*main, (0x8825, 4, 1, bytes(4))], 8))))]
    first = block(with_place, 8)
    tiff = b"II*\0" + struct.pack("<I", 8) + first
    tiff += block(place, len(tiff)) if i % 5 else struct.pack("<H", 0) + bytes(4)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xc0" + struct.pack(">HBHH", 8, 8, 300 + i % 9, 400 + i % 11) + b"\x01\xff\xda"


def exif_values(spark, sf_dir):
    rows = images.metadata(_files(spark, sf_dir, exif_bytes))
    return rows.select(F.col("path").cast("long").alias("item_idx"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "camera_make", F.col("orientation").cast("long").alias("orientation"), F.round("exposure_seconds", 9).alias("exposure"), F.col("iso").cast("long").alias("iso"), F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"))


def tensor_layout(spark, sf_dir):
    """Where the green of the pixel in row 1, column 2 of a 2 by 3 image stands in either layout, and the size."""

    def place(i):
        pixels = np.zeros((1, 2, 3, 3), np.uint8)
        pixels[0, 1, 2, 1] = 255
        flat = features.tensor(pixels, Normalisation((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), ("NCHW", "NHWC")[i % 2]).reshape(-1)
        return int(flat.argmax()), len(flat)

    return _mapped(_ids(spark, sf_dir), place, "place long, size long")


def clip_normalise(spark, sf_dir):
    c = F.col("item_idx") % 256
    return _ids(spark, sf_dir).select("item_idx", *[F.round(vectors.scale_channel(c, m, s).cast("double"), 4).alias(n) for n, m, s in zip(("r", "g", "b"), CLIP.mean, CLIP.std, strict=True)])


def model_input_size(spark, sf_dir):
    """Height and width that a model's input shape asks for in its layout; the settings' size where it leaves them open."""
    shapes = (([1, 3, 224, 320], "NCHW"), ([None, 320, 288, 3], "NHWC"), (["batch", 3, None, None], "NCHW"), ([16, 3, 64, 64], "NCHW"))

    def read(i):
        shape, layout = shapes[i % 4]
        return features.input_size(shape, Settings(size=320, layout=layout))

    return _mapped(_ids(spark, sf_dir), read, "height long, width long")


def _items(spark, sf_dir):
    from twinweave.plans.queries import media_view

    return media_view(spark, sf_dir)


def reset_items(spark, sf_dir):
    """Items after both resets, and none after clearing."""
    rows = media.reset_features(media.reset_processed(_items(spark, sf_dir).withColumn("processed_path", F.col("file_path"))))
    kept = rows.unionByName(media.clear(rows))
    return kept.select("item_idx", F.col("processed_path").isNull().alias("no_path"), F.col("features").isNull().alias("no_features"))


def empty_result(spark, sf_dir):
    """The header of an analysis of no items."""
    found, _ = clustering.analyse(media.clear(_items(spark, sf_dir)), 0.75)
    return groups.header(found, 0.75)


def progress_states(spark, sf_dir):
    i = F.col("item_idx")
    total = F.when(i % 9 == 0, F.lit(0)).otherwise(i % 40 + 1)
    now = i % 41
    return _ids(spark, sf_dir).select("item_idx", display.progress_value(now, total).alias("value"), display.progress_complete(now, total).alias("complete"), display.progress_text(F.lit("Scanning"), now, total).alias("text"))


def text_lookup(spark, sf_dir):
    texts = Texts([("a", "first"), ("b", "second"), ("a", "last")])
    key = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("item_idx") % 3 + 1).cast("int"))
    return _ids(spark, sf_dir).select("item_idx", texts.column(key).alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        image_borders, image_crop, image_orient, image_resize, image_preprocess, image_outcome, png_headers, exif_values,
        tensor_layout, clip_normalise, model_input_size, reset_items, empty_result, progress_states, text_lookup,
    )
}

_I = "(SELECT vec_id AS item_idx FROM embeddings)"
_RATIO = """(SELECT *, CASE method WHEN 'Padding' THEN least(40.0 / w, 40.0 / h) ELSE greatest(40.0 / w, 40.0 / h) END AS ratio FROM
(SELECT item_idx, 20 * (1 + item_idx % 4) AS w, 20 * (1 + item_idx % 3) AS h, list_extract(['Stretch', 'Crop', 'Padding'], CASE WHEN item_idx % 2 = 1 THEN item_idx % 3 ELSE item_idx // 2 % 3 END + 1) AS method FROM """ + _I + "))"

ORACLE_SQL = {
    "image_borders": f"WITH {_FRAMED_SQL} SELECT * FROM cut",
    "image_crop": f"WITH {_FRAMED_SQL} SELECT item_idx, width, height, 60::BIGINT AS green FROM cut",
    "image_orient": f"""SELECT item_idx, CASE WHEN o BETWEEN 5 AND 8 THEN 2 ELSE 3 END::BIGINT AS width, CASE WHEN o BETWEEN 5 AND 8 THEN 3 ELSE 2 END::BIGINT AS height,
CASE WHEN o IN (2, 3) THEN 2 WHEN o IN (6, 7) THEN 1 ELSE 0 END::BIGINT AS x, CASE WHEN o IN (3, 4) THEN 1 WHEN o IN (7, 8) THEN 2 ELSE 0 END::BIGINT AS y FROM (SELECT item_idx, item_idx % 10 AS o FROM {_I})""",
    "image_resize": f"""SELECT item_idx, method, 40::BIGINT AS width, 40::BIGINT AS height, CASE method WHEN 'Padding' THEN round_even(w * ratio, 0)::BIGINT * round_even(h * ratio, 0)::BIGINT ELSE 1600 END::BIGINT AS own,
(item_idx % 200)::BIGINT AS value FROM {_RATIO}""",
    "image_preprocess": f"""WITH {_FRAMED_SQL} SELECT item_idx, CASE WHEN item_idx % 7 = 0 THEN 0 ELSE width END::BIGINT AS width, CASE WHEN item_idx % 7 = 0 THEN 0 ELSE height END::BIGINT AS height,
CASE WHEN item_idx % 7 = 0 THEN 0 ELSE width * height * 3 END::BIGINT AS n_bytes, item_idx % 7 = 0 AS failed FROM cut""",
    "image_outcome": f"SELECT count(*) FILTER (WHERE item_idx % 7 > 0) AS succeeded, count(*) FILTER (WHERE item_idx % 7 = 0) AS failed FROM {_I}",
    "png_headers": f"""SELECT item_idx, CASE WHEN ok THEN 100 + item_idx % 50 END AS width, CASE WHEN ok THEN 200 + item_idx % 70 END AS height,
CASE WHEN ok THEN CASE WHEN item_idx % 3 = 0 THEN 101.6::DOUBLE ELSE 96.0::DOUBLE END END AS dpi_x, CASE WHEN ok THEN CASE WHEN item_idx % 3 = 0 THEN 50.8::DOUBLE ELSE 96.0::DOUBLE END END AS dpi_y,
CASE WHEN ok THEN list_extract(['Rgba8', 'Gray8', 'Rgba16', 'Gray16'], item_idx % 4 + 1) END AS pixel_format, CASE WHEN ok THEN item_idx % 4 = 2 END AS has_alpha,
CASE WHEN ok THEN list_extract([32, 8, 64, 16], item_idx % 4 + 1)::BIGINT END AS bits, NOT ok AS failed FROM (SELECT item_idx, item_idx % 9 > 0 AS ok FROM {_I})""",
    "exif_values": f"""SELECT item_idx, 400 + item_idx % 11 AS width, 300 + item_idx % 9 AS height, 'Maker' AS camera_make, item_idx % 8 + 1 AS orientation, round(1::DOUBLE / (50 + item_idx % 200), 9) AS exposure, 100 * (1 + item_idx % 30) AS iso,
CASE WHEN item_idx % 5 > 0 THEN round((item_idx % 80 + (item_idx % 60) / 60::DOUBLE + 30 / 3600::DOUBLE) * CASE WHEN item_idx % 2 = 1 THEN -1 ELSE 1 END, 9) END AS latitude,
CASE WHEN item_idx % 5 > 0 THEN round(item_idx % 170 + 15 / 60::DOUBLE + 30 / 3600::DOUBLE, 9) END AS longitude FROM {_I}""",
    "tensor_layout": f"SELECT item_idx, CASE WHEN item_idx % 2 = 0 THEN 11 ELSE 16 END::BIGINT AS place, 18::BIGINT AS size FROM {_I}",
    "clip_normalise": "SELECT vec_id AS item_idx, " + ", ".join(f"round((((vec_id % 256)::FLOAT / 255::FLOAT - {m}::FLOAT) * (1::FLOAT / {s}::FLOAT))::DOUBLE, 4) AS {n}" for n, m, s in zip(("r", "g", "b"), CLIP.mean, CLIP.std, strict=True)) + " FROM embeddings",
    "model_input_size": f"""SELECT item_idx, list_extract([224, 320, 320, 64], item_idx % 4 + 1)::BIGINT AS height,
list_extract([320, 288, 320, 64], item_idx % 4 + 1)::BIGINT AS width FROM {_I}""",
    "reset_items": f"SELECT item_idx, TRUE AS no_path, TRUE AS no_features FROM {_I}",
    "empty_result": "SELECT 0.75::DOUBLE AS threshold, 0::BIGINT AS total_groups, 0::BIGINT AS duplicate_groups, 0::BIGINT AS single_groups, 0::BIGINT AS duplicate_items, 0::BIGINT AS total_items",
    "progress_states": f"""SELECT item_idx, CASE WHEN total > 0 THEN now_ / total::DOUBLE ELSE 0 END AS value, now_ >= total AS complete,
CASE WHEN total > 0 THEN 'Scanning ' || now_ || '/' || total || ' (' || (floor(now_ * 1000 / total::DOUBLE + 0.5)::BIGINT // 10) || '.' || (floor(now_ * 1000 / total::DOUBLE + 0.5)::BIGINT % 10) || '%)' ELSE 'Scanning' END AS text
FROM (SELECT item_idx, item_idx % 41 AS now_, CASE WHEN item_idx % 9 = 0 THEN 0 ELSE item_idx % 40 + 1 END AS total FROM {_I})""",
    "text_lookup": f"SELECT item_idx, CASE item_idx % 3 WHEN 0 THEN 'last' WHEN 1 THEN 'second' ELSE '' END AS text FROM {_I}",
}
