"""Feature vectors: pixel scaling, tensor layout, ONNX inference in Arrow batches, or vectors that are there already."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.config import Normalisation, Settings
from twinweave.sources.files import model_file


class Embedder(Protocol):
    """Adds ``features`` (array<float>) to rows of items; null where there is none."""

    def embed(self, items: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class PrecomputedEmbedder:
    """Takes a column that holds the vectors."""

    column: str = "embedding"

    def embed(self, items: DataFrame) -> DataFrame:
        return items.withColumn("features", F.col(self.column).cast("array<float>"))


def tensor(pixels: np.ndarray, norm: Normalisation, layout: str = "NCHW") -> np.ndarray:
    """Scaled float32 values of RGB images (n, h, w, 3), laid out for the model."""
    mean, inverse = np.float32(norm.mean), np.float32(1.0) / np.float32(norm.std)
    out = (pixels.astype(np.float32) / np.float32(255.0) - mean) * inverse
    return np.ascontiguousarray(out.transpose(0, 3, 1, 2)) if layout == "NCHW" else out


def model_shape(session) -> dict:
    """Names, types and dimensions of the first input and output."""
    i, o = session.get_inputs()[0], session.get_outputs()[0]
    return {"input": i.name, "input_shape": list(i.shape), "output": o.name, "output_shape": list(o.shape)}


def fixed_batch(shape: list) -> int | None:
    """The batch size that a model insists on, if it does."""
    return shape[0] if isinstance(shape[0], int) and shape[0] > 0 else None


def input_size(shape: list, settings: Settings) -> tuple[int, int]:
    """(height, width) of a model's input in the settings' layout; the settings' size where the model leaves them open."""
    sides = shape[2:4] if settings.layout == "NCHW" else shape[1:3]
    return tuple(x if isinstance(x, int) and x > 0 else settings.size for x in sides)


_sessions: dict[int, object] = {}


def open_session(model: bytes):
    """One session for each worker and model; CPU, all graph optimisations."""
    import onnxruntime

    key = hash(model)
    if key not in _sessions:
        options = onnxruntime.SessionOptions()
        options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
        options.intra_op_num_threads = 1
        _sessions.clear()
        _sessions[key] = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
    return _sessions[key]


def infer(run, batch: np.ndarray, insists: int | None = None) -> list[np.ndarray | None]:
    """A vector for each image; a failing batch is tried image by image, a failing image has none.

    ``run`` maps a batch to outputs. A model that insists on a batch size gets the last batch padded.
    """
    size = len(batch)

    def once(part: np.ndarray) -> np.ndarray:
        if insists and len(part) < insists:
            part = np.concatenate([part, np.repeat(part[-1:], insists - len(part), axis=0)])
        return np.asarray(run(part))

    try:
        return [row.reshape(-1).astype(np.float32) for row in once(batch)[:size]]
    except Exception:
        out: list[np.ndarray | None] = []
        for k in range(size):
            try:
                out.append(once(batch[k : k + 1])[0].reshape(-1).astype(np.float32))
            except Exception:
                out.append(None)
        return out


class OnnxEmbedder:
    """Vectors from a model given as bytes or a path on the driver; the bytes are broadcast once."""

    def __init__(self, model: bytes | str, settings: Settings | None = None):
        if isinstance(model, str):
            model = model_file(model)
        self.model, self.settings = model, settings or Settings()

    def embed(self, items: DataFrame) -> DataFrame:
        """Rows (item_idx, width, height, pixels) of preprocessed images with features and their dimensions."""
        settings = self.settings
        held = items.sparkSession.sparkContext.broadcast(self.model)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            session = open_session(held.value)
            shape = model_shape(session)
            insists = fixed_batch(shape["input_shape"])
            size = min(settings.batch_size, insists or settings.batch_size)
            height, width = input_size(shape["input_shape"], settings)
            call = lambda x: session.run([shape["output"]], {shape["input"]: x})[0]
            for rows in batches:
                good = rows[(rows["width"] == width) & (rows["height"] == height) & rows["pixels"].notna()]
                vectors: dict[int, np.ndarray | None] = {}
                for at in range(0, len(good), size):
                    part = good.iloc[at : at + size]
                    pixels = np.stack([np.frombuffer(p, np.uint8).reshape(height, width, 3) for p in part["pixels"]])
                    vectors |= dict(zip(part.index, infer(call, tensor(pixels, settings.normalisation, settings.layout), insists), strict=True))
                features = [vectors.get(i) for i in rows.index]
                yield pd.DataFrame({"item_idx": rows["item_idx"], "features": features, "feature_dims": [None if f is None else [1, len(f)] for f in features]})

        return items.select("item_idx", "width", "height", "pixels").mapInPandas(run, "item_idx long, features array<float>, feature_dims array<int>")
