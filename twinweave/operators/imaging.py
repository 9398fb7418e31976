"""Image kernels: orientation, border detection, cropping and resampling, one narrow Arrow stage.

Pixels are height x width x 3 arrays of RGB bytes. A row that cannot be processed gets an error text and no
pixels; the run goes on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.config import Settings

SMALLEST_SIDE = 20
SMALLEST_REST = 10
SAMPLES = 20
UNIFORM_SHARE = 0.85
#: Bytes of pixels that a task hands on at once, besides one image.
PART_BYTES = 8 << 20


def orient(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as they should be seen, by the EXIF orientation 1 to 8."""
    steps = {2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.swapaxes(0, 1), 6: lambda p: np.rot90(p, -1), 7: lambda p: p[::-1, ::-1].swapaxes(0, 1), 8: lambda p: np.rot90(p)}
    return np.ascontiguousarray(steps[orientation](pixels)) if orientation in steps else pixels


def _lines_match(lines: np.ndarray, tolerance: int) -> int:
    """Depth of the border: index of the first line that is not of the first line's colour; 0 if there is none.

    ``lines`` are the lines from the edge to half the side, sampled along.
    """
    colour = lines[0].astype(np.int64).sum(axis=0) // lines.shape[1]
    close = (np.abs(lines.astype(np.int64) - colour) <= tolerance).all(axis=2).mean(axis=1) >= UNIFORM_SHARE
    return 0 if close.all() else int(np.argmin(close))


def borders(pixels: np.ndarray, tolerance: int = 80) -> tuple[int, int, int, int]:
    """(x, y, width, height) of what is inside uniform borders; the whole image where there are none."""
    h, w = pixels.shape[:2]
    whole = (0, 0, w, h)
    if w < SMALLEST_SIDE or h < SMALLEST_SIDE:
        return whole
    least = max(2, min(w, h) // 100)
    rows = pixels[:, :: max(1, w // SAMPLES)]
    cols = pixels[:: max(1, h // SAMPLES)].swapaxes(0, 1)
    found = [_lines_match(x, tolerance) for x in (rows[: h // 2], rows[::-1][: h // 2], cols[: w // 2], cols[::-1][: w // 2])]
    top, bottom, left, right = (x if x >= least else 0 for x in found)
    width, height = w - left - right, h - top - bottom
    return whole if width < SMALLEST_REST or height < SMALLEST_REST else (left, top, width, height)


def crop_borders(pixels: np.ndarray, tolerance: int = 80) -> np.ndarray:
    x, y, w, h = borders(pixels, tolerance)
    return pixels[y : y + h, x : x + w]


def _cubic(b: float, c: float):
    def weight(x: np.ndarray) -> np.ndarray:
        near = ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + (6 - 2 * b)) / 6
        far = ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + (8 * b + 24 * c)) / 6
        return np.where(x < 1, near, np.where(x < 2, far, 0.0))

    return weight


#: Kernel and reach by sampling method; nearest has none.
KERNELS = {
    "Bilinear": (lambda x: np.maximum(0.0, 1 - x), 1.0),
    "Bicubic": (_cubic(0.0, 0.5), 2.0),
    "Lanczos": (lambda x: np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0.0), 3.0),
    "MitchellNetravali": (_cubic(1 / 3, 1 / 3), 2.0),
}


def _weights(old: int, new: int, method: str) -> np.ndarray:
    scale = old / new
    centre = (np.arange(new) + 0.5) * scale - 0.5
    if method not in KERNELS:
        out = np.zeros((new, old))
        out[np.arange(new), np.minimum(((np.arange(new) + 0.5) * scale).astype(int), old - 1)] = 1
        return out
    kernel, _ = KERNELS[method]
    out = kernel(np.abs(np.arange(old)[None, :] - centre[:, None]) / max(scale, 1.0))
    return out / out.sum(axis=1, keepdims=True)


def resample(pixels: np.ndarray, width: int, height: int, method: str, companding: bool = False) -> np.ndarray:
    """Separable resampling to a size; in linear light if companding."""
    if pixels.shape[:2] == (height, width):
        return pixels
    x = pixels.astype(np.float64)
    if companding:
        x = (x / 255) ** 2.2 * 255
    x = np.einsum("ij,jkc->ikc", _weights(pixels.shape[0], height, method), x)
    x = np.einsum("ij,kjc->kic", _weights(pixels.shape[1], width, method), x)
    if companding:
        x = (np.clip(x, 0, 255) / 255) ** (1 / 2.2) * 255
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def choose_sampling(width, height, settings: Settings) -> str:
    """Down or up method: the longer side decides, for Crop the shorter."""
    side = min(width, height) if settings.resize_method == "Crop" else max(width, height)
    return settings.downsampling if side > settings.size else settings.upsampling


def sampling_expr(width: Column | str, height: Column | str, size: int, method: str, down: str, up: str) -> Column:
    """The same choice as an expression."""
    pick = F.least if method == "Crop" else F.greatest
    return F.when(pick(width, height) > size, down).otherwise(up)


def resize(pixels: np.ndarray, settings: Settings) -> np.ndarray:
    """A square of the settings' size: cropped to fill, padded to fit, or stretched."""
    h, w = pixels.shape[:2]
    s = settings.size
    method = choose_sampling(w, h, settings)
    if settings.resize_method == "Stretch":
        return resample(pixels, s, s, method, settings.companding)
    ratio = (max if settings.resize_method == "Crop" else min)(s / w, s / h)
    nw, nh = max(1, round(w * ratio)), max(1, round(h * ratio))
    scaled = resample(pixels, nw, nh, method, settings.companding)
    if settings.resize_method == "Crop":
        x, y = (nw - s) // 2, (nh - s) // 2
        return scaled[y : y + s, x : x + s]
    colour = [settings.padding_colour >> k & 255 for k in (16, 8, 0)]
    out = np.empty((s, s, 3), np.uint8)
    out[:] = colour
    x, y = (s - nw) // 2, (s - nh) // 2
    out[y : y + nh, x : x + nw] = scaled
    return out


def from_image_struct(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB pixels of Spark's image source (rows of blue, green, red, and perhaps alpha)."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return raw[:, :, [0, 0, 0]] if channels == 1 else raw[:, :, 2::-1]


def process(pixels: np.ndarray, orientation: int, settings: Settings) -> np.ndarray:
    """Orient, crop borders, resize, as far as the settings say."""
    out = orient(pixels, orientation)
    if settings.detect_borders:
        out = crop_borders(out, settings.border_tolerance)
    return resize(out, settings) if settings.resize else out


def in_parts(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of about PART_BYTES of pixels each: however many rows a batch has, a task holds that much of what it makes."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= PART_BYTES:
            yield pd.DataFrame(part, columns=columns)
            part, size = [], 0
    if part:
        yield pd.DataFrame(part, columns=columns)


def preprocess(images: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(item_idx, width, height, pixels, error) from (item_idx, image struct, orientation)."""
    settings = settings or Settings()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for rows in batches:
            for r in rows.itertuples():
                try:
                    pixels = process(from_image_struct(r.height, r.width, r.channels, r.data), int(r.orientation or 1), settings)
                    yield r.item_idx, pixels.shape[1], pixels.shape[0], pixels.tobytes(), None
                except Exception as e:  # one bad image is a row, not the run's end
                    yield r.item_idx, 0, 0, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_parts(made(batches), ["item_idx", "width", "height", "pixels", "error"])

    orientation = F.col("orientation") if "orientation" in images.columns else F.lit(1)
    flat = images.select("item_idx", F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"), orientation.cast("int").alias("orientation"))
    return flat.mapInPandas(run, "item_idx long, width int, height int, pixels binary, error string")


def outcome(processed: DataFrame) -> DataFrame:
    return processed.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
