"""Helpers shared by the training-data operators: table access, hashing and byte-level word scans.

A *word* is a maximal run of bytes other than space and the control bytes 9 to 13. All of these
separators are single bytes in UTF-8, so words of a whole Arrow batch can be found with numpy on the
raw string buffer, without building Python strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; bounds the memory of a Python worker, whose arrays take some 50 bytes for each.
CHUNK_BYTES = 512 << 10

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table; Spark's reader alone touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of a column's decimal text, modulo n (null: null)."""
    return F.crc32(F.col(column).cast("string")) % n


def map_rows(df: DataFrame, step: Callable[..., list], schema: str, *args) -> DataFrame:
    """Apply ``step(columns: list of lists, *args) -> list of lists`` to bounded slices of Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for part in slices(batch):
                made = step([c.to_pylist() for c in part.columns], *args)
                out = out or _arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(made, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


arrow_schema = _arrow_schema


def slices(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes; one longer row stands alone."""
    n = batch.num_rows
    if not n:
        return
    size = np.zeros(n, dtype=np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            size += np.diff(_offsets(c))
    done = np.cumsum(size)
    at = 0
    while at < n:
        base = done[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(done, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(column.buffers()[1], dtype=np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column's rows, without copies of the strings; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = _offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A to Z in small letters: bytes of these have bit 5 clear; comparing is quicker than a table of all bytes."""
    return data | (data - np.uint8(65) < np.uint8(26)).view(np.uint8) << np.uint8(5)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of all words: byte positions, and the index of each row's first word (rows + 1 entries)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = (data != np.uint8(32)) & (data - np.uint8(9) > np.uint8(4))
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = 1 << max(16, int(n + 1).bit_length())
        for k, b in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that depend on the spans' bytes alone (a prefix sum of a polynomial)."""
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


#: Bytes of a span that ``short_hashes`` reads eight at a time; longer spans go by ``span_hashes``.
SHORT = 64
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def short_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As ``span_hashes``, with other values: eight bytes of each span at a time, quicker where most spans are words of few bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - start
    out = mix64((eight[start] & _KEPT[np.minimum(size, 8)]) + size.astype(np.uint64) * _BASE)
    at, done = np.flatnonzero((size > 8) & (size <= SHORT)), 8
    while len(at):
        out[at] = mix64((out[at] ^ eight[start[at] + done] & _KEPT[np.minimum(size[at] - done, 8)]) * _BASE)
        done += 8
        at = at[size[at] > done]
    long = np.flatnonzero(size > SHORT)
    if len(long):
        out[long] = span_hashes(data, start[long], end[long])
    return out
