"""Counts of characters, words, lines and repeats of whole texts, by numpy on Arrow's string buffers.

Shared by the quality rules (operator 2) and the quality classifier (operator 7). One narrow pass, memory
bounded by a few MB of text at a time (or one longer text). Null texts count as empty: all counts are 0.
Equal words and lines are recognised by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import arrow_schema, mix64, slices, span_hashes, text_bytes, word_bounds

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_unique_words", "n_adjacent",
    "n_upper", "n_lower", "n_digits", "n_pipes", "n_bangs", "n_ends", "n_lines",
)

_KIND = np.zeros(256, dtype=np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 pipe, 5 other symbol, 6 exclamation, 7 space or control, 8 continuation
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in "#*$%&<>"]] = 5
_KIND[ord("|")] = 4
_KIND[ord("!")] = 6
_KIND[[9, 10, 11, 12, 13, 32]] = 7
_KIND[0x80:0xC0] = 8
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord("."), ord(",")]] = True


def seen_before(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For entries in order of row: whether an equal value stands earlier in the same row."""
    out = np.zeros(len(value), bool)
    if len(value):
        key = mix64(value ^ mix64(row.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out[order[1:][same]] = True
    return out


def seen_twice(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether an equal value stands anywhere else in the same row."""
    out = np.zeros(len(value), bool)
    if len(value):
        key = mix64(value ^ mix64(row.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def window_hashes(words: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of ``width`` words that lies in one row."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    return at, total[at]


def count(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All of COUNTS for the rows of a string buffer."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(rows) * 9, size) + _KIND[data], minlength=rows * 9).reshape(rows, 9)
    start, end, first = word_bounds(data, offsets)
    n_words = np.diff(first)
    row = np.repeat(np.arange(rows), n_words)
    words = span_hashes(data, start, end)

    at, windows = window_hashes(words, row, 5)
    twice = at[seen_twice(row[at], windows)]
    cover = np.zeros(len(words) + 6, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    covered = np.cumsum(cover)[: len(words)] > 0

    feeds = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets[:-1], offsets[1:], feeds, feeds + 1]))
    line_start, line_end = cuts[:-1], cuts[1:]
    proper = ~((line_end - line_start == 1) & (data[line_start] == 10)) if len(cuts) > 1 else np.zeros(0, bool)
    line_start, line_end = line_start[proper], line_end[proper]
    has_word = np.searchsorted(start, line_start) < np.searchsorted(start, line_end)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    repeated = seen_before(line_row, span_hashes(data, line_start, line_end))

    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])

    def per_row(where: np.ndarray) -> np.ndarray:
        return np.bincount(where, minlength=rows)

    return {
        "n_words": n_words,
        "word_chars": size - kinds[:, 7] - kinds[:, 8],
        "n_symbols": kinds[:, 4] + kinds[:, 5],
        "n_dup_lines": per_row(line_row[repeated]),
        "n_repeat_words": per_row(row[covered]),
        "n_unique_words": n_words - per_row(row[seen_before(row, words)]),
        "n_adjacent": per_row(row[again]),
        "n_upper": kinds[:, 1],
        "n_lower": kinds[:, 2],
        "n_digits": kinds[:, 3],
        "n_pipes": kinds[:, 4],
        "n_bangs": kinds[:, 6],
        "n_ends": per_row(row[_ENDS[data[end - 1]]]) if len(end) else np.zeros(rows, np.int64),
        "n_lines": per_row(line_row),
    }


def with_stats(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns (strings as they are, others as long) and all of COUNTS."""
    kinds = dict(df.dtypes)
    ddl = ",".join([f"{c} {'string' if kinds[c] == 'string' else 'long'}" for c in keep] + [f"{c} long" for c in COUNTS])
    rows = df.select(*[F.col(c) if kinds[c] == "string" else F.col(c).cast("long").alias(c) for c in keep], F.col(text_col).alias("__text"))

    def run(batches):
        schema = arrow_schema(ddl)
        for batch in batches:
            for part in slices(batch):
                *kept, texts = part.columns
                got = count(*text_bytes(texts))
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], schema=schema)

    return rows.mapInArrow(run, ddl)


def stats_column(text_col: str = "text"):
    """All of COUNTS of a text column as one struct, beside any other columns."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counts_of(texts: pd.Series) -> pd.DataFrame:
        made = []
        for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["text"])):
            got = count(*text_bytes(part.column(0)))
            made.append(pd.DataFrame({c: got[c].astype(np.int64) for c in COUNTS}))
        return pd.concat(made, ignore_index=True) if made else pd.DataFrame({c: np.zeros(0, np.int64) for c in COUNTS})

    return counts_of(F.col(text_col))
