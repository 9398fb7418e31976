"""Image headers: dimensions, resolution and EXIF data from a file's bytes, without decoding pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.functions import paths

META = (
    "width int, height int, dpi_x double, dpi_y double, pixel_format string, has_alpha boolean, bits_per_pixel int, orientation int, camera_make string, camera_model string, "
    "taken_at string, exposure_seconds double, f_number double, iso int, focal_length double, exposure_bias double, flash int, white_balance int, lens string, copyright string, "
    "software string, author string, description string, title string, latitude double, longitude double, altitude double, error string"
)
_NAMES = [x.split()[0] for x in META.split(", ")]
_WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 12: 8}
#: EXIF tags by property.
TAGS = {
    0x010F: "camera_make", 0x0110: "camera_model", 0x0112: "orientation", 0x0131: "software", 0x013B: "author", 0x8298: "copyright", 0x010E: "title",
    0x829A: "exposure_seconds", 0x829D: "f_number", 0x8827: "iso", 0x9003: "taken_at", 0x9204: "exposure_bias", 0x9209: "flash", 0x920A: "focal_length",
    0xA403: "white_balance", 0xA434: "lens", 0x9286: "description",
}


def dimensions(data: bytes) -> tuple[int, int]:
    """(width, height) by the header; an error for unknown formats."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data)
    if data[:2] == b"\xff\xd8":
        for marker, body in _segments(data):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", body[1:5])
                return w, h
    if data[:4] in (b"II*\0", b"MM\0*"):
        tags = read_tags(data)
        return int(tags[0x0100][0]), int(tags[0x0101][0])
    raise ValueError("unknown image format")


def _webp(data: bytes) -> tuple[int, int]:
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    w, h = struct.unpack("<HH", data[26:30])
    return w & 0x3FFF, h & 0x3FFF


def _segments(data: bytes):
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xDA:
            return
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def read_tags(tiff: bytes, start: int | None = None) -> dict[int, list]:
    """Values by tag of one directory of a TIFF structure."""
    e = "<" if tiff[:2] == b"II" else ">"
    at = struct.unpack(e + "I", tiff[4:8])[0] if start is None else start
    out: dict[int, list] = {}
    for i in range(struct.unpack(e + "H", tiff[at : at + 2])[0]):
        tag, kind, n, _ = struct.unpack(e + "HHII", tiff[at + 2 + 12 * i : at + 14 + 12 * i])
        size = _WIDTHS.get(kind, 0) * n
        if not size or size > len(tiff):
            continue
        spot = at + 10 + 12 * i
        spot = spot if size <= 4 else struct.unpack(e + "I", tiff[spot : spot + 4])[0]
        raw = tiff[spot : spot + size]
        if len(raw) < size:
            continue
        if kind in (2, 7):
            out[tag] = [raw.split(b"\0")[0].decode("utf-8", "replace") if kind == 2 else raw]
        elif kind in (5, 10):
            v = struct.unpack(e + ("I" if kind == 5 else "i") * 2 * n, raw)
            out[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)]
        else:
            out[tag] = list(struct.unpack(e + {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 12: "d"}[kind] * n, raw))
    return out


def exif(data: bytes) -> dict:
    """Named properties from EXIF data; blank texts are null, a place only with both coordinates."""
    tiff = data if data[:4] in (b"II*\0", b"MM\0*") else next((b[6:] for m, b in _segments(data) if m == 0xE1 and b[:6] == b"Exif\0\0"), b"") if data[:2] == b"\xff\xd8" else b""
    if not tiff:
        return {}
    main = read_tags(tiff)
    tags = dict(main)
    if 0x8769 in main:
        tags |= read_tags(tiff, int(main[0x8769][0]))
    out = {}
    for tag, name in TAGS.items():
        if tag in tags:
            v = tags[tag][0]
            if isinstance(v, bytes):
                v = v[8:].decode("utf-8", "replace").strip("\0")
            out[name] = (v.strip() or None) if isinstance(v, str) else v
    if out.get("taken_at", None) and out["taken_at"][:4] in ("0000", "0001"):
        out["taken_at"] = None
    if 0x8825 in main:
        gps = read_tags(tiff, int(main[0x8825][0]))
        if all(k in gps and len(gps[k]) == 3 for k in (2, 4)):
            for k, name, negative in ((2, "latitude", "S"), (4, "longitude", "W")):
                d, m, s = gps[k]
                out[name] = (d + m / 60 + s / 3600) * (-1 if gps.get(k - 1, [""])[0] == negative else 1)
        if 6 in gps:
            out["altitude"] = gps[6][0] * (-1 if gps.get(5, [0])[0] == 1 else 1)
    return out


def properties(data: bytes) -> dict:
    """Dimensions, resolution and pixel format by the header."""
    w, h = dimensions(data)
    out = {"width": w, "height": h, "dpi_x": 96.0, "dpi_y": 96.0, "pixel_format": "Bgra8", "has_alpha": False, "bits_per_pixel": 32, "orientation": 1}
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        depth, colour = data[24], data[25]
        out["has_alpha"] = colour in (4, 6)
        gray = colour in (0, 4)
        out["pixel_format"] = ("Gray16" if depth == 16 else "Gray8") if gray else "Rgba16" if depth == 16 else "Rgba8"
        out["bits_per_pixel"] = {"Gray8": 8, "Gray16": 16, "Rgba16": 64, "Rgba8": 32}[out["pixel_format"]]
        at = data.find(b"pHYs")
        if at > 0 and data[at + 12] == 1:
            x, y = struct.unpack(">II", data[at + 4 : at + 12])
            out["dpi_x"], out["dpi_y"] = x * 0.0254, y * 0.0254
    elif (density := _density(data)) and min(density) > 0:
        out["dpi_x"], out["dpi_y"] = density
    return out


def _density(data: bytes) -> tuple[float, float] | None:
    """Dots per inch by the header of a JPEG, BMP or TIFF file, where it says so."""
    if data[:2] == b"\xff\xd8":
        for marker, body in _segments(data):
            if marker == 0xE0 and body[:5] == b"JFIF\0":
                unit, x, y = struct.unpack(">BHH", body[7:12])
                return {1: (float(x), float(y)), 2: (x * 2.54, y * 2.54)}.get(unit)
    elif data[:2] == b"BM" and len(data) >= 46:
        x, y = struct.unpack("<ii", data[38:46])
        return x * 0.0254, y * 0.0254
    elif data[:4] in (b"II*\0", b"MM\0*"):
        tags = read_tags(data)
        if 0x011A in tags and 0x011B in tags:
            scale = {1: 0.0, 3: 2.54}.get(int(tags.get(0x0128, [2])[0]), 1.0)
            return tags[0x011A][0] * scale, tags[0x011B][0] * scale
    return None


def _unpack_bits(raw: bytes) -> bytes:
    """Bytes of the run-length scheme of TIFF files."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def decode_tiff(data: bytes) -> np.ndarray:
    """RGB pixels of a TIFF file in strips of 8-bit gray, RGB or RGBA samples: plain, deflated or run-length coded; an error for others."""
    tags = read_tags(data)
    one = lambda tag, other: int(tags.get(tag, [other])[0])
    width, height, samples, packing = one(0x0100, 0), one(0x0101, 0), one(0x0115, 1), one(0x0103, 1)
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bits}.get(packing)
    if unpack is None or any(b != 8 for b in tags.get(0x0102, [1])) or samples not in (1, 3, 4) or one(0x011C, 1) != 1 or 0x0111 not in tags or one(0x0106, 1) > 2:
        raise ValueError("a kind of TIFF that is not read")
    raw = b"".join(unpack(data[int(a) : int(a) + int(n)]) for a, n in zip(tags[0x0111], tags[0x0117], strict=True))
    pixels = np.frombuffer(raw[: width * height * samples], np.uint8).reshape(height, width, samples)
    if one(0x013D, 1) == 2:
        pixels = np.cumsum(pixels, axis=1, dtype=np.uint8)
    if samples == 1:
        pixels = 255 - pixels if one(0x0106, 1) == 0 else pixels
        return np.repeat(pixels, 3, axis=2)
    return np.ascontiguousarray(pixels[:, :, :3])


def read_metadata(data: bytes) -> dict:
    """All of META; what cannot be read is null, with the error's text."""
    out = dict.fromkeys(_NAMES)
    try:
        out |= properties(data)
        out |= exif(data)
    except (ValueError, struct.error, KeyError, IndexError) as e:
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def metadata(files: DataFrame) -> DataFrame:
    """(path, META) of rows (path, content)."""

    def run(batches):
        for rows in batches:
            got = [read_metadata(c) for c in rows["content"]]
            yield pd.DataFrame({"path": rows["path"], **{n: pd.Series([g[n] for g in got], dtype=object) for n in _NAMES}})

    return files.select("path", "content").mapInPandas(run, "path string, " + META)


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Spark's image source: (image struct) for PNG, BMP, JPEG and GIF files; broken files are dropped."""
    return spark.read.format("image").option("dropInvalid", "true").load(folder)


def decoded_or_failed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, image struct, error) of every image file: TIFF files too, and a row with an error for each file that cannot be read.

    WebP files are accepted by the scan, but no reader of this engine's core takes them: they are such rows.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content").where(paths.is_image("path"))
    is_tiff = F.substring("content", 1, 4).isin(bytearray(b"II*\0"), bytearray(b"MM\0*"))
    kind = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"

    def tiffs(batches):
        for rows in batches:
            made = []
            for path, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    pixels = decode_tiff(content)
                    made.append((path, pixels.shape[0], pixels.shape[1], 3, 16, pixels[:, :, ::-1].tobytes(), None))
                except (ValueError, struct.error, KeyError, IndexError, zlib.error) as e:
                    made.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(made, columns=["path", "height", "width", "nChannels", "mode", "data", "error"])

    ours = files.where(is_tiff).mapInPandas(tiffs, "path string, height int, width int, nChannels int, mode int, data binary, error string")
    ours = ours.select("path", F.when(F.col("error").isNull(), F.struct(F.col("path").alias("origin"), "height", "width", "nChannels", "mode", "data")).cast(kind).alias("image"), "error")
    spark_s = decoded(spark, folder).select(F.col("image.origin").alias("origin"), "image")
    others = files.where(~is_tiff).select("path").join(spark_s, F.regexp_replace("path", "^file:/*", "/") == F.regexp_replace("origin", "^file:/*", "/"), "left")
    return ours.unionByName(others.select("path", F.col("image").cast(kind).alias("image"), F.when(F.col("image").isNull(), "no image that can be read").alias("error")))
