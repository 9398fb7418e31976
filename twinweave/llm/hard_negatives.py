"""Hard negatives by bit-sliced integer products (operator 12).

Rows of a query set, the anchors, are held against all rows, in blocks. A component x stands as floor(256 * x), and
scores are integer inner products. A row's components are cut into bit-planes. Products with the planes are added from
the most significant one on: after each, a score is known up to what the planes below can still give, an interval that
halves from plane to plane, and a candidate is dropped as soon as its interval cannot qualify any more. What survives
all planes has an exact score.

1. An anchor's positives are its best rows of the same label. An interval qualifies if it reaches the last of the best
   that are known so far.
2. Negatives have another label and a score in a window below a positive's (see ``Rule``). An interval qualifies if it
   meets a window, from the last of the best that are known so far on.

Both passes deal packed blocks of rows to units of work, (group of anchors, share of the rows). A unit is one stream in
one task: its anchors first (at most ANCHOR_BYTES), then block after block of rows, with the best of each anchor as the
only state. So memory does not grow with the rows, and each pass shuffles rows once for each group of anchors. The best
of all shares are ranked by a window of few rows an anchor. Nothing passes through the driver but two counts.

Defined results: rows with a null id, label or vector, or a component that is null or not finite, take no part. Vectors
of unequal length are compared as if zeros followed the shorter; empty ones score 0. A component of 65,536 or more is an
error (scores might not fit). Of several rows with an anchor's id, the one with the least label, then the least vector,
is the anchor; rows with that id are no candidates of it. Repeated rows are candidates each for itself. Ties go to the
smaller id. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.common import arrow_schema
from twinweave.operators.checkpoints import materialise

#: Rows of a packed block, anchors that are multiplied at once, and rows that are multiplied at once.
BLOCK_ROWS, ANCHOR_ROWS, STEP_ROWS = 1024, 1024, 1024
#: Bytes of anchors of a unit of work (4 a component), and rows of a share at most, however many cores there are.
ANCHOR_BYTES, SHARE_ROWS = 32 << 20, 4 << 20
#: Share of pairs from which on they are followed one by one, not as a matrix.
FEW = 1 / 16
_PACKED = "unit int,kind int,n int,dims int,ids binary,labels binary,vectors binary,extra binary"
#: Components stay below, scores stay within.
_LARGEST, _FAR = 1 << 24, 1 << 60


@dataclass(frozen=True)
class Rule:
    """Which rows are anchors, how vectors become integers, and which negatives are hard.

    A negative's score s qualifies for a positive's score p if low * p <= 100 * s <= high * p.
    """

    scale: int = 256
    anchor_every: int = 50
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


DEFAULT = Rule()


def valid(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    held = rows.select(F.col(id_col).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return held.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def quantise(vectors: pa.ListArray, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), zeros after the end of a shorter vector."""
    at = np.asarray(vectors.offsets)
    size = np.diff(at)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)[at[0] : at[-1]]
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = np.floor(scale * flat)
    if np.abs(out).max(initial=0) >= _LARGEST:
        raise ValueError(f"a component of {_LARGEST // scale} or more: scores might not fit")
    return out.astype(np.int32)


# --- one block of anchors against one block of rows


def survivors(anchors: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray | None = None, best: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all allowed pairs whose score lies within the anchor's [low, high].

    With ``best``, pairs that cannot be among an anchor's ``best`` highest are dropped too (equals stay).
    """
    dims = min(anchors.shape[1], rows.shape[1])
    a, lifted = anchors[:, :dims].astype(np.int64), rows[:, :dims].astype(np.int64)
    shift = max(0, -int(lifted.min(initial=0)))
    lifted = lifted + shift  # no bit-plane of signs is needed then
    planes = int(lifted.max(initial=0)).bit_length()
    up, down, base = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1), a.sum(1) * -shift
    most = int(np.abs(a).sum(1).max(initial=0)) * ((1 << planes) + shift)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    alive = np.ones((len(a), len(rows)), bool) if allowed is None else allowed
    known = np.repeat(base.astype(kind)[:, None], len(rows), axis=1)
    left = a.astype(kind)
    p = planes
    while True:
        rest = (1 << p) - 1
        # scores lie in [known + rest * down, known + rest * up]
        alive = alive & (known >= (low - rest * up).astype(kind)[:, None]) & (known <= (high - rest * down).astype(kind)[:, None])
        if best and alive.shape[1] > best:
            inside = alive & (known >= (low - rest * down).astype(kind)[:, None]) & (known <= (high - rest * up).astype(kind)[:, None])
            sure = np.where(inside, known, kind(-_FAR))
            last = np.partition(sure, alive.shape[1] - best, axis=1)[:, alive.shape[1] - best]
            alive &= known >= last[:, None] + (rest * (down - up)).astype(kind)[:, None]
        if not p or alive.mean() <= FEW:
            break
        p -= 1
        known += left @ ((lifted >> p) & 1).T.astype(kind) * kind(1 << p)
    i, j = np.nonzero(alive)
    score = known[i, j].astype(np.int64)
    while p and len(i):
        p -= 1
        rest = (1 << p) - 1
        bit = (lifted >> p) & 1
        score += np.concatenate([np.einsum("ij,ij->i", a[i[k : k + 65536]], bit[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) << p
        keep = (score >= (low - rest * up)[i]) & (score <= (high - rest * down)[i])
        i, j, score = i[keep], j[keep], score[keep]
    return i, j, score


def leaders(keys: tuple[np.ndarray, ...], score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k of every key, by falling score, then rising id; in order."""
    order = np.lexsort((ids, -score, *keys[::-1]))
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = np.all([x[order][1:] == x[order][:-1] for x in keys], axis=0)
    start = np.flatnonzero(~same)
    place = np.arange(len(order)) - np.repeat(start, np.diff([*start, len(order)]))
    return order[place < k]


class _Anchors:
    """The anchors of a unit, and the best candidates that were seen for each window of each."""

    def __init__(self, rule: Rule, passes: int):
        self.rule, self.passes, self.parts = rule, passes, []
        self.k = rule.positives if passes == 1 else rule.negatives

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, extra: np.ndarray) -> None:
        self.parts.append((ids, labels, vectors, extra))

    def begin(self) -> None:
        rule = self.rule
        wide = max((x[2].shape[1] for x in self.parts), default=0)
        self.ids, self.labels = (np.concatenate([x[i] for x in self.parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
        self.vectors = np.concatenate([np.pad(x[2], ((0, 0), (0, wide - x[2].shape[1]))) for x in self.parts] or [np.zeros((0, 0), np.int32)])
        n = len(self.ids)
        if self.passes == 1:
            self.low, self.high = np.full((n, 1), -_FAR), np.full((n, 1), _FAR)
        else:
            scores = np.concatenate([x[3].reshape(len(x[0]), -1) for x in self.parts]) if self.parts else np.zeros((0, rule.positives), np.int64)
            there = scores > np.iinfo(np.int64).min
            kept = np.where(there, scores, 0)
            self.low, self.high = np.where(there, -(-kept * rule.low // 100), _FAR), np.where(there, kept * rule.high // 100, -_FAR)
        self.floor = self.low.copy()  # scores below cannot be among the best of a window
        none = np.zeros(0, np.int64)
        self.best = [none, none, none, none]  # anchor, window, score, id

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(self.ids), ANCHOR_ROWS):
            for to in range(0, len(ids), STEP_ROWS):
                self._meet(slice(at, at + ANCHOR_ROWS), ids[to : to + STEP_ROWS], labels[to : to + STEP_ROWS], vectors[to : to + STEP_ROWS])

    def _meet(self, own: slice, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        low, high = self.floor[own].min(1, initial=_FAR), self.high[own].max(1, initial=-_FAR)
        if self.passes == 1:
            found = []
            for value in np.unique(self.labels[own]):
                mine, theirs = np.flatnonzero(self.labels[own] == value), np.flatnonzero(labels == value)
                if len(theirs):
                    i, j, score = survivors(self.vectors[own][mine], vectors[theirs], low[mine], high[mine], self.ids[own][mine][:, None] != ids[theirs][None, :], self.k)
                    found.append((mine[i], theirs[j], score))
            if not found:
                return
            i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            mine = np.flatnonzero(low <= high)
            other = (self.labels[own][mine][:, None] != labels[None, :]) & (self.ids[own][mine][:, None] != ids[None, :])
            i, j, score = survivors(self.vectors[own][mine], vectors, low[mine], high[mine], other)
            i = mine[i]
        i = i + own.start
        took, window = np.nonzero((score[:, None] >= self.floor[i]) & (score[:, None] <= self.high[i]))
        if len(took):
            more = [i[took], window, score[took], ids[j[took]]]
            held = [np.concatenate(x) for x in zip(self.best, more, strict=True)]
            keep = leaders((held[0], held[1]), held[2], held[3], self.k)
            self.best = [x[keep] for x in held]
            anchor, window, score, _ = self.best
            last = np.flatnonzero(np.append((anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1]), True))
            full = last[(last >= self.k - 1)]
            full = full[(anchor[full - self.k + 1] == anchor[full]) & (window[full - self.k + 1] == window[full])]
            self.floor[anchor[full], window[full]] = np.maximum(self.floor[anchor[full], window[full]], score[full])

    def result(self) -> list[np.ndarray]:
        anchor, window, score, ids = self.best
        return [self.ids[anchor], window, ids, score]


# --- dealing blocks to units


def _numbers(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(-1, dims) if dims else np.zeros((0, 0), np.int32)


def _packed(rows: DataFrame, kind: int, groups: int, shares: int, scale: int) -> DataFrame:
    """Blocks of rows for each unit that needs them: a block of anchors (kind 0) goes to every share of its group, a block of rows (kind 1) to every group of its share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_PACKED)
        number = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                vectors = quantise(part.column(2), scale)
                extra = np.asarray(part.column(3).flatten()).astype(np.int64).tobytes() if part.num_columns > 3 else b""
                number += 1
                units = [number % groups * shares + s for s in range(shares)] if kind == 0 else [g * shares + number % shares for g in range(groups)]
                one = [kind, part.num_rows, vectors.shape[1], np.asarray(part.column(0)).astype(np.int64).tobytes(), np.asarray(part.column(1)).astype(np.int64).tobytes(), vectors.tobytes(), extra]
                for unit in units:
                    yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip([unit, *one], schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, _PACKED)


def _matched(anchors: DataFrame, rows: DataFrame, rule: Rule, passes: int, groups: int, shares: int) -> DataFrame:
    """(anchor_id, window, other_id, score): what each share of the rows has as best candidates of an anchor's windows."""
    dealt = _packed(anchors, 0, groups, shares, rule.scale).unionAll(_packed(rows, 1, groups, shares, rule.scale))
    keyed = dealt.repartitionById(groups * shares, "unit").sortWithinPartitions("unit", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("anchor_id long,window int,other_id long,score long")
        unit, held, begun = None, None, False

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(held.result(), schema, strict=True)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["unit"] != unit:
                    if begun:
                        yield made()
                    unit, held, begun = row["unit"], _Anchors(rule, passes), False
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                vectors = _numbers(row["vectors"], row["dims"]) if row["dims"] else np.zeros((len(ids), 0), np.int32)
                if row["kind"] == 0:
                    held.add(ids, labels, vectors, np.frombuffer(row["extra"], np.int64))
                    continue
                if not begun:
                    held.begin()
                    begun = True
                held.meet(ids, labels, vectors)
        if begun:
            yield made()

    return keyed.mapInArrow(run, "anchor_id long, window int, other_id long, score long")


def mine(rows: DataFrame, rule: Rule = DEFAULT, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) of all hard negatives."""
    spark = rows.sparkSession
    held = valid(rows, id_col, vector_col, label)
    first = held.where(F.col("id") % rule.anchor_every == 0).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("m"))
    anchors = materialise(first.select("id", "m.label", "m.vector"), "anchors")
    size, n = anchors.agg(F.coalesce(F.sum(F.size("vector") * 4 + 64), F.lit(0))).first()[0], held.count()
    groups = max(1, -(-size // ANCHOR_BYTES))
    shares = max(1, -(-n // SHARE_ROWS), min(-(-spark.sparkContext.defaultParallelism // groups), n // BLOCK_ROWS))

    found = _matched(anchors, held, rule, 1, groups, shares)
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id"))).where(F.col("n") <= rule.positives)
    positives = materialise(found.select("anchor_id", F.col("n").alias("positive_rank"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    none = F.lit(-(1 << 63)).cast("long")
    by_rank = positives.groupBy(F.col("anchor_id").alias("id")).agg(*[F.coalesce(F.max(F.when(F.col("positive_rank") == k, F.col("positive_score"))), none).alias(f"p{k}") for k in range(1, rule.positives + 1)])
    asked = anchors.join(by_rank, "id").select("id", "label", "vector", F.array(*[f"p{k}" for k in range(1, rule.positives + 1)]).alias("scores"))
    hard = _matched(asked, held, rule, 2, groups, shares)
    hard = hard.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "other_id"))).where(F.col("rank") <= rule.negatives)
    hard = hard.select("anchor_id", (F.col("window") + 1).alias("positive_rank"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = positives.join(hard, ["anchor_id", "positive_rank"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
