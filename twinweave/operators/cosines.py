"""The arithmetic of similarities in numpy: float products, added one after another in double."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: What a matrix product of unit vectors may be off by, many times over.
MARGIN = 1e-5
#: Pairs of items up to which a mean counts copies one by one.
COUNTED_PAIRS = 1 << 20


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of a and rows of b (float32), summed in order in double; 0 where a magnitude is 0."""
    if not len(a):
        return np.zeros(0)
    total = np.cumsum((a * b).astype(np.float64), axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))
    size = magnitudes(a) * magnitudes(b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size == 0, 0.0, total / size)


def magnitudes(a: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum((a * a).astype(np.float64), axis=1)[:, -1]) if a.shape[1] else np.zeros(len(a))


def exact_means(vectors: np.ndarray, weights: np.ndarray) -> Callable[[list[int], list[list[int]]], np.ndarray]:
    """A function of a cluster and others: its mean cosine with each of these, over members in order; a vector counts as often as its weight says.

    Up to COUNTED_PAIRS pairs of items are added one by one; beyond that, copies are multiplied, which may differ in the last digit.
    """

    def means(one: list[int], others: list[list[int]]) -> np.ndarray:
        if len(one) == 1 and all(len(x) == 1 for x in others):
            return exact_cosines(vectors[one], vectors[[x[0] for x in others]])
        out = []
        for x in others:
            a, b = weights[one].astype(np.int64), weights[x].astype(np.int64)
            sims = exact_cosines(np.repeat(vectors[one], len(x), axis=0), np.tile(vectors[x], (len(one), 1))).reshape(len(one), len(x))
            pairs = int(a.sum()) * int(b.sum())
            if pairs <= COUNTED_PAIRS:
                total = np.cumsum(np.repeat(np.repeat(sims, a, axis=0), b, axis=1).reshape(-1))[-1]
            else:
                total = np.cumsum((sims * np.outer(a, b)).reshape(-1))[-1]
            out.append(total / pairs)
        return np.array(out)

    return means
