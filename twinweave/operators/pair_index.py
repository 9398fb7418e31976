"""Pairs by cosine similarity with a metric index: pairs of blocks that cannot reach the threshold are never made.

Angles between vectors obey the triangle inequality, so two vectors whose angles to some third one differ by more than
the threshold's angle are less similar than the threshold. The index uses it for whole blocks:

1. Some vectors are pivots (spread over a bounded sample; they decide what is saved, never what is found). Every vector
   belongs to its nearest pivot, and within it to a ring of angles.
2. Rings are joined or dealt out into blocks of about ``block_rows``. Blocks of a ring are of one *class*. Each block is
   packed into one row once, with the least and largest angle of its vectors to every pivot.
3. Two classes meet unless their intervals are further apart, for some pivot, than the threshold's angle. Only the
   intervals of classes (PIVOTS + 2 CLASSES rows of PIVOTS at most) are seen by the driver, and only its list of partners is sent out.
4. Neighbouring blocks form a bounded number of *stacks*; a unit of work is a pair of stacks, and a packed block goes to
   the stacks that hold a partner of its. So a block is sent SPREAD times at most however many blocks there are, until a
   stack would pass STACK_BYTES. In a unit only blocks that are partners meet: a matrix product proposes and the arithmetic
   of ``exact_cosines`` decides, so rows are those of the full grid, bit by bit.

Vectors whose float products could lose digits (very large or very small components) are kept out of the reckoning with
angles: their class meets every other. Vectors without a length have similarity 0 with all, so for a threshold above 0 they
are left out.

With ``products``, rows are means of unit vectors and similarities their products. None is longer than 1, so a product at a
threshold above 0 is a cosine at it or above, and the same blocks meet. With ``earlier``, pairs of two rows that are marked so
are not made: earlier rows are in classes of their own, which meet only others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.operators.checkpoints import discard, materialise
from twinweave.operators.cosines import MARGIN, exact_cosines, magnitudes

#: Bounds of the index: pivots, vectors of the sample for each pivot, rings of a pivot, classes.
PIVOTS, SAMPLE_EACH, RINGS, CLASSES = 256, 8, 32, 2048
#: Rows of a block at most, and of one matrix product.
BLOCK_ROWS, STEP_ROWS = 8192, 1024
#: Stacks at least (rows allowing), and bytes of vectors that one holds at most, besides a block: a unit holds one stack and a block of the other.
SPREAD, STACK_BYTES = 16, 128 << 20
#: What angles may be off by, many times over.
SLACK = 1e-5
#: Vectors whose largest component lies between these are multiplied as floats without losing digits.
_SMALL, _LARGE = 1e-12, 1e12
_SUB = 1 << 24
#: Earlier rows of cell c are in cell _EARLIER - c.
_EARLIER = -3
#: What a product of near means may be off by, several times over, and products up to which angles say nothing sure.
NEAR, _SHORT = 1e-6, 1e-3
_BLOCK = "block long,class int,n long,low binary,high binary,ids binary,vectors binary,sources array<string>"


@dataclass
class Report:
    """What an index saves: pairs of rows in units of work, and all pairs of rows."""

    visited: int = 0
    pairs: int = 0
    blocks: int = 0

    @property
    def share(self) -> float:
        return self.visited / self.pairs if self.pairs else 0.0


def _stacked(column: pa.ListArray) -> np.ndarray:
    at = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float32)[at[0] : at[-1]]
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of rows to unit pivots, in double."""
    x = vectors.astype(np.float64)
    length = np.sqrt((x * x).sum(axis=1))
    return np.arccos(np.clip(x @ pivots.T / np.where(length == 0, 1, length)[:, None], -1.0, 1.0))


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` unit vectors of a sample, each as far as may be from those before it."""
    x = sample.astype(np.float64)
    length = np.sqrt((x * x).sum(axis=1))
    x = x[(length > 0) & np.isfinite(length)] / length[(length > 0) & np.isfinite(length)][:, None]
    chosen: list[int] = []
    nearest = np.full(len(x), -1.0)
    for _ in range(min(count, len(x))):
        k = int(np.argmin(nearest)) if chosen else 0
        if chosen and nearest[k] > 1 - 1e-9:
            break
        chosen.append(k)
        nearest = np.maximum(nearest, x @ x[k])
    return x[chosen] if chosen else np.zeros((1, sample.shape[1] if sample.ndim > 1 else 0))


def placed(held: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """(item_idx, source_id, vector, cell, ring): the cell of its nearest pivot, or -1 for vectors that angles say nothing sure about."""
    shared = held.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _stacked(batch.column(2))
            size, most = magnitudes(v), np.abs(v).max(axis=1, initial=0.0)
            away = angles(np.where(np.isfinite(v), v, 0), shared.value)
            cell = away.argmin(axis=1).astype(np.int32) if len(v) else np.zeros(0, np.int32)
            near = away[np.arange(len(v)), cell]
            sure = (most > _SMALL) & (most < _LARGE)
            cell = np.where(sure, cell, -1).astype(np.int32)
            cell = np.where(batch.column(3).to_numpy(zero_copy_only=False), _EARLIER - cell, cell).astype(np.int32)
            ring = np.where(sure, np.minimum((near * (RINGS / np.pi)).astype(np.int32), RINGS - 1), 0)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(cell), pa.array(ring.astype(np.int32))], names=["item_idx", "source_id", "vector", "cell", "ring"])
            yield out.filter(pa.array((size > 0) & np.isfinite(size))) if threshold > 0 else out

    earlier = F.col("earlier") if "earlier" in held.columns else F.lit(False)
    return held.select("item_idx", "source_id", "features", earlier.alias("earlier")).mapInArrow(run, "item_idx long, source_id string, vector binary, cell int, ring int")


def dealt(counts: list[tuple[int, int, int]], block_rows: int, most: int = CLASSES) -> list[tuple[int, int, int, int]]:
    """(cell, ring, class, blocks of the class) from (cell, ring, rows): neighbouring rings are joined until they fill a block."""
    out, made, rows = [], -1, 0
    last = None
    block_rows = max(block_rows, -(-sum(n for _, _, n in counts) // most))
    filled: list[int] = []
    for cell, ring, n in sorted(counts):
        if cell != last or rows + n > block_rows:
            made, rows, last = made + 1, 0, cell
            filled.append(0)
        rows += n
        filled[made] = rows
        out.append((cell, ring, made))
    return [(cell, ring, k, -(-filled[k] // block_rows)) for cell, ring, k in out]


def packed(rows: DataFrame, classes: list[tuple[int, int, int, int]], pivots: np.ndarray) -> DataFrame:
    """Blocks as rows: ids, sources, vectors, and the least and largest angle to every pivot."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    # at most RINGS * PIVOTS rows
    of = F.broadcast(spark.createDataFrame(classes or [(-2, 0, 0, 1)], "cell int, ring int, class int, k int"))
    sub = F.pmod(F.xxhash64("item_idx"), F.col("k"))
    keyed = rows.join(of, ["cell", "ring"]).select("item_idx", "source_id", "vector", "class", "cell", (F.col("class").cast("long") * _SUB + sub).alias("block"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("item_idx")
        vectors = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float32).reshape(table.num_rows, -1)
        away = angles(vectors, shared.value) if table["cell"][0].as_py() not in (-1, _EARLIER + 1) else np.tile([[0.0], [np.pi]], (1, len(shared.value)))
        low, high = away.min(axis=0), away.max(axis=0)
        one = [table["block"][0].as_py(), table["class"][0].as_py(), table.num_rows, low.tobytes(), high.tobytes(), table["item_idx"].to_numpy().tobytes(), vectors.tobytes(), table["source_id"].to_pylist()]
        return pa.table({name: pa.array([x], type=kind) for (name, kind), x in zip(_FIELDS, one, strict=True)})

    return keyed.groupBy("block").applyInArrow(pack, _BLOCK)


_FIELDS = [("block", pa.int64()), ("class", pa.int32()), ("n", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary()), ("sources", pa.list_(pa.string()))]


def intervals(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, least angles, largest angles) of every class; the bounded table that the driver sees."""

    def merge(table: pa.Table) -> pa.Table:
        low, high = (np.stack([np.frombuffer(x, np.float64) for x in table[c].to_pylist()]) for c in ("low", "high"))
        return pa.table({"class": table["class"][:1], "n": pa.array([int(table["n"].to_numpy().sum())]), "low": pa.array([low.min(axis=0).tobytes()], pa.binary()), "high": pa.array([high.max(axis=0).tobytes()], pa.binary())})

    found = blocks.select("class", "n", "low", "high").groupBy("class").applyInArrow(merge, "class int, n long, low binary, high binary").toArrow().sort_by("class")
    low, high = (np.array([np.frombuffer(x, np.float64) for x in found[c].to_pylist()]) for c in ("low", "high"))
    return found["n"].to_numpy(), low, high


def partners(low: np.ndarray, high: np.ndarray, threshold: float) -> np.ndarray:
    """Which classes (rows) may hold a vector that is similar to one of a class (columns)."""
    reach = float(np.arccos(np.clip(threshold - MARGIN, -1.0, 1.0))) + SLACK
    out = np.zeros((len(low), len(low)), bool)
    for k in range(len(low)):
        gap = np.maximum(low - high[k], low[k] - high).max(axis=1, initial=0.0)
        out[k] = gap <= reach
    return out


def compare(left: Block, right: Block, same: bool, threshold: float, constrained: bool, products: bool = False) -> Iterator[pa.RecordBatch]:
    """(i, j, sim) of two blocks, a bounded matrix at a time. With products, sources are sets of which no two rows of a pair share one."""
    for p in range(0, len(left.ids), STEP_ROWS):
        for q in range(p if same else 0, len(right.ids), STEP_ROWS):
            with np.errstate(invalid="ignore"):
                near = left.units[p : p + STEP_ROWS] @ right.units[q : q + STEP_ROWS].T >= threshold - MARGIN
            i, j = np.nonzero(near)
            i, j = i + p, j + q
            keep = left.ids[i] < right.ids[j] if same else np.ones(len(i), bool)
            if constrained and not products:
                keep &= left.sources[i] != right.sources[j]
            i, j = i[keep], j[keep]
            for k in range(0, len(i), 8192):
                m, n = i[k : k + 8192], j[k : k + 8192]
                if products:
                    sims = np.einsum("ij,ij->i", left.vectors[m].astype(np.float64), right.vectors[n].astype(np.float64))
                    good = sims >= threshold - NEAR
                    if constrained:
                        good[good] = [not (a and b and a & b) for a, b in zip(left.sources[m[good]], right.sources[n[good]], strict=True)]
                else:
                    sims = exact_cosines(left.vectors[m], right.vectors[n])
                    good = sims >= threshold
                one, other = left.ids[m[good]], right.ids[n[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other)), pa.array(sims[good])], names=["i", "j", "sim"])


@dataclass
class Block:
    """Rows of a packed block, or of neighbouring ones together."""

    ids: np.ndarray
    vectors: np.ndarray
    units: np.ndarray
    sources: np.ndarray

    @classmethod
    def opened(cls, ids: bytes, vectors: bytes, sources: list, products: bool = False) -> Block:
        at = np.frombuffer(ids, np.int64)
        v = np.frombuffer(vectors, np.float32).reshape(len(at), -1)
        if products:
            sets = np.empty(len(at), object)
            sets[:] = [frozenset(json.loads(s)) if s else None for s in sources]
            return cls(at, v, v, sets)
        return cls(at, v, v / np.where((m := magnitudes(v)) == 0, 1, m)[:, None].astype(np.float32), np.array(sources, object))

    @classmethod
    def joined(cls, blocks: list[Block]) -> Block:
        return blocks[0] if len(blocks) == 1 else cls(*(np.concatenate([getattr(b, f) for b in blocks]) for f in ("ids", "vectors", "units", "sources")))


def stacked(rows: list[tuple[int, int]], width: int, spread: int) -> dict[int, int]:
    """The stack of each block, from (block, rows) in order and the bytes of a row: even shares of the rows, STACK_BYTES and a block at most."""
    total = sum(n for _, n in rows)
    share = max(1, min(-(-total // spread), STACK_BYTES // max(1, width)))
    out, stack, before, last = {}, -1, 0, -1
    for block, n in rows:
        if before // share != last:
            stack, last = stack + 1, before // share
        out[block] = stack
        before += n
    return out


def indexed_pairs(held: DataFrame, threshold: float, constrained: bool, rows: int, block_rows: int | None = None, pivots: int | None = None, report: Report | None = None, products: bool = False) -> DataFrame:
    """(i, j, sim) with i < j and sim >= threshold of (item_idx, source_id, features); features are read twice.

    A column ``earlier`` marks rows of which no two are compared. With products, features are means of unit vectors, source_id
    is a JSON list of sources or null, and pairs are those whose product may be at the threshold.
    """
    spark: SparkSession = held.sparkSession
    cores = spark.sparkContext.defaultParallelism
    block_rows = block_rows or max(128, min(BLOCK_ROWS, rows // 16))
    count = min(PIVOTS, pivots or max(8, int(rows**0.5) // 4))
    sample = held.select("features", F.xxhash64("item_idx").alias("h")).orderBy("h").limit(count * SAMPLE_EACH).toArrow()["features"].combine_chunks()
    centres = spread_out(_stacked(sample) if len(sample) else np.zeros((0, 1), np.float32), count)

    spots = materialise(placed(held, centres, threshold), "spots")
    counts = [tuple(r) for r in spots.groupBy("cell", "ring").count().collect()]  # a row for each ring of a pivot
    classes = dealt(counts, block_rows)
    blocks = materialise(packed(spots, classes, centres), "blocks")
    discard(spots)
    n, low, high = intervals(blocks)
    meet = np.ones((len(n), len(n)), bool) if products and threshold < _SHORT else partners(low, high, threshold)
    earlier = np.zeros(len(n), bool)
    earlier[[k for cell, _, k, _ in classes if cell < -1]] = True
    meet &= ~(earlier[:, None] & earlier[None, :])
    sizes = [tuple(r) for r in blocks.select("block", "n").orderBy("block").collect()]  # CLASSES + PIVOTS classes and their shares of block_rows
    if report is not None:
        a, b = np.nonzero(np.triu(meet, 1))
        report.visited = int((n[a] * n[b]).sum() + (n * (n - 1) // 2).sum())
        report.pairs, report.blocks = rows * (rows - 1) // 2, len(sizes)
    stack_of = stacked(sizes, 4 * centres.shape[1], SPREAD)
    stacks = max(stack_of.values(), default=-1) + 1
    holds = np.zeros((len(n), stacks), bool)  # class by stack
    for block, stack in stack_of.items():
        holds[block // _SUB, stack] = True
    reaches = (meet.astype(np.float32) @ holds.astype(np.float32)) > 0
    shared = spark.sparkContext.broadcast((meet, reaches, stack_of))

    @F.pandas_udf("array<struct<a:int,b:int,stack:int>>")
    def units_of(block: pd.Series) -> pd.Series:
        _, reached, stack = shared.value
        return pd.Series([[{"a": min(stack[x], int(y)), "b": max(stack[x], int(y)), "stack": stack[x]} for y in np.flatnonzero(reached[x // _SUB])] for x in block])

    units = int((holds.T.astype(np.float32) @ reaches.astype(np.float32) > 0).sum())
    sent = blocks.select("block", "ids", "vectors", "sources").withColumn("unit", F.explode(units_of("block"))).select("unit.*", "block", "ids", "vectors", "sources")
    tasks = max(1, min(units, max(cores, rows // 1024)))
    keyed = sent.repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "stack", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = shared.value[0]
        unit, held, classes_held, whole = None, [], np.zeros(0, np.int64), None
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, stack, block, *packed_row = (batch.column(c)[k].as_py() for c in range(7))
                if (a, b) != unit:
                    unit, held, whole = (a, b), [], None
                one, own = Block.opened(*packed_row, products), block // _SUB
                if a == b and allowed[own, own]:
                    yield from compare(one, one, True, threshold, constrained, products)
                if a == b or stack == b:
                    if whole is None or a == b:
                        classes_held = np.array([c for c, _ in held], np.int64)
                    near = allowed[own][classes_held]
                    if a != b and near.all() and held:
                        whole = whole or Block.joined([x for _, x in held])
                        yield from compare(whole, one, False, threshold, constrained, products)
                    elif near.any():
                        yield from compare(Block.joined([held[p][1] for p in np.flatnonzero(near)]), one, False, threshold, constrained, products)
                if stack == a:
                    held.append((own, one))

    return keyed.mapInArrow(run, "i long, j long, sim double")
