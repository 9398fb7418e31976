"""Sets of word shingles and their PartEnum signatures, by numpy on string buffers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from twinweave.llm.common import lower_ascii, mix64, span_hashes, word_bounds

#: Similarity as a fraction: links need NUM * union <= DEN * intersection.
NUM, DEN = 85, 100
WIDTH = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): every row's distinct shingles as sorted 64-bit hashes; fewer words make one shingle, none make none."""
    data = lower_ascii(data)
    start, end, first = word_bounds(data, offsets)
    words = span_hashes(data, start, end)
    n = np.diff(first)
    rows = len(n)
    count = np.where(n >= width, n - width + 1, n > 0).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(rows), count)
    base = first[:-1][row] + np.arange(at[-1]) - at[row]
    span = np.minimum(n, width)[row]
    value = span.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for i in range(width):
        value = np.where(i < span, mix64(value * _ODD + padded[base + i]), value)
    for i in range(rows):
        value[at[i] : at[i + 1]].sort()
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    new[at[:-1][count > 0]] = True
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=rows))])


def fingerprints(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = []
    for salt in (1, 2):
        total = np.zeros(len(at) - 1, np.uint64)
        np.add.at(total, rows, mix64(value ^ mix64(np.full(1, salt, np.uint64))))
        out.append(total)
    return out[0], out[1]


def band_ends(limit: int = 1 << 40, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Largest size of every size band; sets that can link lie in one band or in neighbours."""
    ends, low = [], 1
    while low < limit:
        ends.append(low * den // num)
        low = ends[-1] + 1
    return np.array(ends, np.int64)


@dataclass(frozen=True)
class Measure:
    """What is compared, and from where on it is linked: words of a shingle, and the similarity num / den."""

    width: int = WIDTH
    num: int = NUM
    den: int = DEN

    @cached_property
    def ends(self) -> np.ndarray:
        return band_ends(num=self.num, den=self.den)

    def may_link(self, size_a, size_b, distance):
        """Whether sets of these sizes can link if they differ in at least ``distance`` elements."""
        return (self.den + self.num) * distance <= (self.den - self.num) * (size_a + size_b)


DEFAULT = Measure()


def signatures(value: np.ndarray, at: np.ndarray, measure: Measure = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all sets.

    Instance j of the scheme serves pairs whose larger band is j, so a set of band b takes part in b and
    b + 1. Linked sets of at most r elements differ in at most k = 2 r (den - num) / (den + num) elements.
    The hash domain is cut into k // 2 + 1 parts, so that some part holds at most one difference, and each
    part into three; of the three, two are then equal, and the signature is one of the three unions of two.
    """
    size = np.diff(at)
    band = np.searchsorted(measure.ends, size)
    rows_out, sig_out = [], []
    spread = mix64(value ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    high = value >> np.uint64(32)
    owner = np.repeat(np.arange(len(size)), size)
    for step in (0, 1):
        j = band + step
        k = 2 * measure.ends[j] * (measure.den - measure.num) // (measure.den + measure.num)
        parts = np.where((size > 0) & (k > 0), k // 2 + 1, 0)
        cells = 3 * parts
        first = np.concatenate([[0], np.cumsum(cells)])
        live = parts[owner] > 0
        own = owner[live]
        total = np.zeros(first[-1], np.uint64)
        cell = ((high[live] * cells[own].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        np.add.at(total, first[:-1][own] + cell, spread[live])
        row = np.repeat(np.arange(len(size)), parts)
        part = np.arange(first[-1] // 3) - np.repeat(first[:-1] // 3, parts)
        tag = mix64((j[row].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64) + np.uint64(1))
        a, b, c = total[0::3], total[1::3], total[2::3]
        for t, both in enumerate((a + b, b + c, a + c)):
            rows_out.append(row)
            sig_out.append(mix64(both + tag * np.uint64(2 * t + 1)))
    return np.concatenate(rows_out), np.concatenate(sig_out)


def linked(x: int, y: int, both: int, measure: Measure = DEFAULT) -> bool:
    return measure.den * both >= measure.num * (x + y - both) and both > 0
