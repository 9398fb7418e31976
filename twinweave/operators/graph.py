"""Connected components of a table of pairs, at once and kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.operators.checkpoints import discard, materialise, materialise_with

#: Arcs up to which one task ends the work (about 1 MB); a larger graph is contracted until it is that small.
FEW_ARCS = 1 << 16
#: Pairs that a task takes up before it reduces them, and links that it holds at most before it hands them on.
TAKEN, HELD = 1 << 20, 1 << 19


def _linked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs join: from every node to the least one that it reaches; a node alone has one to itself."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    shown = (label != np.arange(len(nodes))) | (np.bincount(label, minlength=len(nodes)) == 1)
    return nodes[shown], nodes[label[shown]]


def _thinned(pairs: DataFrame) -> DataFrame:
    """(i, j): fewer links that join the same nodes; each task reduces what it reads, a bounded number of pairs at a time, before anything is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        links = taken = 0

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            return _linked(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            taken += batch.num_rows
            if taken >= TAKEN:
                made = reduced()
                held, taken, links = [made], 0, len(made[0])
            if links > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["i", "j"])
                held, links = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in reduced()], names=["i", "j"])

    return pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).mapInArrow(run, "i long, j long")


def _ended(arcs: DataFrame) -> DataFrame:
    """(u, label) of every node of at most FEW_ARCS arcs, by union of trees in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (above := up.setdefault(x, x)) != x:
                up[x] = x = up[above]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(u), top(v)
                up[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array([*up], pa.int64()), pa.array([top(u) for u in [*up]], pa.int64())], names=["u", "label"])

    return arcs.where("u <= v").coalesce(1).mapInArrow(run, "u long, label long")


def components(pairs: DataFrame) -> DataFrame:
    """(item_idx, component_id) for every endpoint of the pairs (i, j); the id is the component's least item.

    While there are many arcs, each node takes the least label among its neighbours, then that node's own, and the graph
    of labels takes the place of the graph: arcs inside a label go, so each round at least halves the nodes that still
    have any. Tasks that read the pairs hand on links that join the same nodes, so what is written grows with the nodes that
    a task sees, not with its pairs. Rounds are written tables, and their number of arcs is the only figure that the driver sees. The last few
    arcs are ended in one task; labels then go back through the rounds. The pairs are read once.
    """
    ends = F.explode(F.array(F.struct(F.col("i").cast("long").alias("u"), F.col("j").cast("long").alias("v")), F.struct(F.col("j").cast("long").alias("u"), F.col("i").cast("long").alias("v"))))
    count = F.count(F.lit(1))
    arcs, n = materialise_with(_thinned(pairs).select(ends.alias("e")).select("e.u", "e.v"), "arcs", count)
    rounds: list[DataFrame] = []
    while n > FEW_ARCS:
        low = materialise(arcs.groupBy("u").agg(F.least("u", F.min("v")).alias("label")), "low")
        step = materialise(low.join(low.select(F.col("u").alias("label"), F.col("label").alias("above")), "label").select("u", F.col("above").alias("label")), "labels")
        rounds.append(step)
        left = arcs.where("u <> v").join(step, "u").join(step.select(F.col("u").alias("v"), F.col("label").alias("other")), "v").where("label <> other")
        fewer, n = materialise_with(left.select(F.col("label").alias("u"), F.col("other").alias("v")).distinct(), "arcs", count)
        discard(low, arcs)
        arcs = fewer
    labels = _ended(arcs)
    for step in reversed(rounds):
        above = labels.select(F.col("u").alias("label"), F.col("label").alias("above"))
        labels = materialise(step.join(above, "label", "left").select("u", F.coalesce("above", "label").alias("label")), "labels")
        discard(step, arcs)
    return labels.select(F.col("u").alias("item_idx"), F.col("label").alias("component_id"))
