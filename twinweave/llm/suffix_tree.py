"""Language-model scores from a probabilistic suffix tree over words (operator 8).

The tree's nodes are contexts of up to DEPTH preceding words. Every context that occurs at least LEAST times in
the training part is a candidate, with all next words that follow it LEAST times; it is retained if these
counts diverge from what its parent (the context without its oldest word) predicts, by a likelihood-ratio
test against the chi-square's mean and spread. A node's distribution is its own counts, mixed with its
parent's distribution by a Witten-Bell weight; the root's is add-one over all training words and one unknown
word. A token is scored in the longest retained suffix of its history; the tree grows no deeper once no
context repeats.

Scale: the limits are counts, not shares, so the tree grows with the corpus; it is a written table and is
never collected as a whole. A sequence of words (a gram) is known by a hash of its first and its last part.
A gram that occurs LEAST times has parts that do, so a bitmap of bounded size keeps most others out of each
depth's shuffle. A document's score is a sum over its grams: a gram adds what its last word gains over the
parent's share, and what the gram as a context leaves to its parent. What is joined at scoring time is the
grams of the document below FREQUENT, packed by buckets of their keys (about a million tokens a bucket); at most 1 / FREQUENT grams a depth are broadcast, to save their
shuffle and its skew, which changes no result. Counts and additions pass between Spark and Python as packed rows too,
because a row of its own costs more on that way than what is done with it. Words are told apart by 64-bit hashes.

Defined results: null and empty texts are the end token alone; an empty training part gives N = V = 0 and
every token probability 1; null ids are neither learned from nor held out; repeated rows are scored
alike (and learned from as often as they stand there).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.common import arrow_schema, crc_mod, lower_ascii, mix64, short_hashes, slices, text_bytes, word_bounds
from twinweave.operators.checkpoints import discard, materialise, materialise_with, writing

DEPTH = 3
LEAST = 2
#: Share of the training tokens from which a gram is broadcast; has no part in the result.
FREQUENT = 4e-7
#: Bits of a bitmap for each key, and the least and the largest size (64 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 29
#: Shares of the documents that are scored one after another, so that what is asked lies on disk by shares.
ROUNDS = 2
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x1D8AF066D2E7A3C5)
#: Tokens whose counts a task sums before it sends them on.
FLUSH = 1 << 20
_WORD_BITS = 20
#: Bytes of text of one step: its arrays, of eight bytes for each, should stay near the processor.
STEP_BYTES = 256 << 10
#: Buckets of the words' counts, as a power of two: they are made before the tokens are counted.
WORD_BUCKETS = 10


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all tokens: each row's words, then its end."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    start, end, first = word_bounds(data, offsets)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    out = np.full(len(start) + rows, END, np.uint64)
    out[np.arange(len(start)) + row] = short_hashes(data, start, end)
    return out, np.repeat(np.arange(rows), np.diff(first) + 1)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Places:
    """Finds values in sorted distinct keys as ``find`` does; as keys are hashes, a table of their high bits leads next to them."""

    STEPS = 12

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        if len(keys):
            self.low, self.high = keys[0], keys[-1]
            self.shift = np.uint64(max(0, int(self.high - self.low).bit_length() - len(keys).bit_length()))
            slots = (int(self.high - self.low) >> int(self.shift)) + 1
            self.first = np.zeros(slots + 1, np.int32)
            np.cumsum(np.bincount(((keys - self.low) >> self.shift).astype(np.int64), minlength=slots), out=self.first[1:])

    def of(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return out
        left = np.flatnonzero((wanted >= self.low) & (wanted <= self.high))
        looked = wanted[left]
        at = self.first[((looked - self.low) >> self.shift).astype(np.int64)]  # the first key of the slot, or one beyond it
        for _ in range(self.STEPS):
            there = self.keys[at]
            hit = there == looked
            out[left[hit]] = at[hit]
            more = np.flatnonzero(there < looked)
            if not len(more):
                return out
            left, looked, at = left[more], looked[more], at[more] + 1
        out[left] = find(self.keys, looked)
        return out


@dataclass
class Tree:
    """The frequent part as sorted arrays; level d - 1 of the lists is depth d. A transition's key is context << 20 | word."""

    total: int
    kinds: int
    words: np.ndarray  # hashes of frequent words, sorted
    counts: np.ndarray
    contexts: list[np.ndarray] = field(default_factory=list)  # keys of the transitions that lead to them
    sizes: list[np.ndarray] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    share: list[np.ndarray] = field(default_factory=list)  # of the context's stored transitions
    weight: list[np.ndarray] = field(default_factory=list)  # of the own distribution; 0: not retained

    def root(self, index: np.ndarray) -> np.ndarray:
        return (self.counts[index] + 1.0) / (self.total + self.kinds + 1)

    def probability(self, depth: int, word: np.ndarray, states: list[np.ndarray]) -> np.ndarray:
        """Of frequent words from their states; for others (-1) the factor on the root's probability."""
        p = np.ones(len(word))
        known = word >= 0
        p[known] = self.root(word[known])
        for d in range(depth):
            at = np.flatnonzero(states[d] >= 0)
            weight = self.weight[d][states[d][at]]
            live = weight > 0
            at, weight = at[live], weight[live]
            hit = find(self.keys[d], states[d][at] << _WORD_BITS | np.maximum(word[at], 0))
            own = np.where((hit >= 0) & known[at], self.share[d][np.maximum(hit, 0)] if len(self.share[d]) else 0.0, 0.0)
            p[at] = weight * own + (1 - weight) * p[at]
        return p


#: The constants of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _hash_long(x: np.ndarray, seed) -> np.ndarray:
    """XXH64 of 8-byte numbers, as Spark's xxhash64 takes it."""
    turn = lambda v, n: v << np.uint64(n) | v >> np.uint64(64 - n)
    h = turn(x * _P2, 31) * _P1 ^ (seed + (_P5 + np.uint64(8)))
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def combine(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The key of a gram from those of its parts without its last and without its first word: Spark's xxhash64(first, last)."""
    with np.errstate(over="ignore"):
        return _hash_long(last, _hash_long(first, np.uint64(42)))


def grams(value: np.ndarray, row: np.ndarray, length: int):
    """(keys, whether there is one) by length, of the grams that end at each token."""
    out = [(value, np.ones(len(value), bool))]
    same = row[1:] == row[:-1]
    for _ in range(1, length):
        key, there = out[-1]
        made, ok = np.zeros(len(value), np.uint64), np.zeros(len(value), bool)
        made[1:] = combine(key[:-1], key[1:])
        ok[1:] = there[1:] & there[:-1] & same
        out.append((made, ok))
    return out


def bitmap_size(count: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * count).bit_length()))


def bitmap_of(keys: DataFrame, count: int) -> np.ndarray:
    """A bitmap of the long column h by the highest bits, sized by the count of keys up to a bound."""
    size = bitmap_size(count)
    high = np.uint64(65 - size.bit_length())

    def places(batches):
        def make(some):
            key = some.column(0).to_numpy().view(np.uint64)
            yield key, (key >> high).astype(np.uint32)

        yield from _packed(batches, make, 8)

    return _bitmap(keys.select("h").mapInArrow(places, "b int,blob binary"), size)


def bitmap_of_blobs(rows: DataFrame, count: int, bits: int, high_of) -> np.ndarray:
    """The same of keys in rows (b, blob) by buckets; ``high_of(blob, highest byte)`` are the highest 32 bits of a blob's keys."""
    size = bitmap_size(count)
    low = np.uint32(33 - size.bit_length())

    def places(batches):
        for batch in batches:
            top = [b >> bits - 8 for b in batch.column(0).to_pylist()]
            made = [(high_of(blob.as_buffer(), t) >> low).tobytes() for blob, t in zip(batch.column(1), top, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(top, pa.int32()), pa.array(made, pa.binary())], names=["b", "blob"])

    return _bitmap(rows.mapInArrow(places, "b int,blob binary"), size)


def _bitmap(places: DataFrame, size: int) -> np.ndarray:
    """From packed places (b: their highest byte); each of the 256 parts is made by one group."""
    part = size >> 8

    def merge(table: pa.Table) -> pa.Table:
        bits = np.zeros(part, np.uint8)
        bits[_unpacked(table.column("blob"), (np.uint32,))[0] & np.uint32(part - 1)] = 1
        return pa.table({"b": table.column("b")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    with writing(places.sparkSession):
        got = places.groupBy("b").applyInArrow(merge, "b int,bits binary").toArrow()
    table = np.zeros((256, part // 64), np.uint64)
    for b, bits in zip(got.column("b").to_pylist(), got.column("bits").to_pylist(), strict=True):
        table[b] = np.frombuffer(bits, np.uint64)
    return table.reshape(-1)


def in_bitmap(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(65 - (64 * len(table)).bit_length())
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one of each, how many) of equal keys, by one plain sort of keys whose low bits give way to their places.

    Keys that agree in all other bits may come in more than one piece; whoever sums pieces by key loses nothing.
    """
    n = len(key)
    low = np.uint64((1 << max(n, 2).bit_length()) - 1)
    order = np.sort(key & ~low | np.arange(n, dtype=np.uint64)) & low
    there = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), there[1:] != there[:-1]]))
    return order[first].astype(np.int64), np.diff(np.append(first, n))


def _deal(key: np.ndarray, bits: int):
    """(bucket, indexes) of the keys by their highest bits, one bucket after another."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(1, (1 << bits) + 1))
    for b, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        if hi > lo:
            yield b, order[lo:hi]


_LOW = np.dtype((np.void, 7))
#: Bytes of an addition in packed rows: low bytes of its key, what it adds, the count of a word.
_ENTRY = 7 + 4 + 8


def _unpacked(blobs: pa.ChunkedArray, kinds: tuple[type, ...]) -> list[np.ndarray]:
    """The columns that packed rows hold: each blob has one array after another."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list] = [[] for _ in kinds]
    for chunk in blobs.chunks:
        for blob in chunk:
            raw = blob.as_buffer()
            n, at = raw.size // width, 0
            for i, k in enumerate(kinds):
                out[i].append(np.frombuffer(raw, k, n, at))
                at += n * np.dtype(k).itemsize
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True)]


#: Rows of a task: the low bits of Spark's increasing ids.
_TASK = np.int64((1 << 33) - 1)


def _asked(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(low bytes of keys, row ids) of packed questions: each blob has its task's first row id, keys, and rows of the task in four bytes."""
    low, rid = [np.zeros(0, _LOW)], [np.zeros(0, np.int64)]
    for chunk in blobs.chunks:
        for blob in chunk:
            raw = blob.as_buffer()
            n = (raw.size - 8) // 11
            low.append(np.frombuffer(raw, _LOW, n, 8))
            rid.append(np.frombuffer(raw, np.uint32, n, 8 + 7 * n) + np.frombuffer(raw, np.int64, 1))
    return np.concatenate(low), np.concatenate(rid)


def _whole(low: np.ndarray, top: int) -> np.ndarray:
    """Keys from their low seven bytes and the highest."""
    key = np.empty((len(low), 8), np.uint8)
    key[:, :7], key[:, 7] = low.view(np.uint8).reshape(-1, 7), top
    return key.reshape(-1).view(np.uint64)


def _packed(batches, make, bits: int, head=lambda: b""):
    """Rows (b, blob) of what ``make(batch)`` gives for slices of batches: (key, *columns), dealt by key and packed FLUSH entries at a time; a blob begins with ``head()``."""
    schema = pa.schema([("b", pa.int32()), ("blob", pa.binary())])
    waiting, size = [], 0

    def flush():
        columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
        dealt = list(_deal(columns[0], bits))
        for i in range(0, len(dealt), 64):
            some = dealt[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int32()), pa.array([head() + b"".join(c[at].tobytes() for c in columns[1:]) for _, at in some], pa.binary())], schema=schema)

    for batch in batches:
        for part in slices(batch, STEP_BYTES):
            for columns in make(part):
                waiting.append(columns)
                size += len(columns[0])
                if size >= FLUSH:
                    yield from flush()
                    waiting, size = [], 0
    if size:
        yield from flush()


def _counts(documents: DataFrame, keys_of, names: tuple[str, ...], bits: int, least: int, ends: bool = False) -> DataFrame:
    """(*names, n, b, high): the keys, given as columns, that ``keys_of(text column)`` makes, with their occurrences n if these are least or more.

    Keys are summed a million tokens at a time, packed by buckets and summed again by bucket. With ends, each
    bucket b ends with a row that has the highest 32 bits of its keys, for a bitmap, and no n.
    """
    whole = lambda columns: columns[0] if len(columns) == 1 else combine(*columns)

    def run(batches):
        waiting, size = [], 0

        def summed():
            columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            key = whole(columns)
            at, n = distinct(key)
            return key[at], *(c[at] for c in columns), n.astype(np.uint32)

        def make(part):
            nonlocal waiting, size
            made = keys_of(part.column(0))
            waiting.append(made)
            size += len(made[0])
            if size >= FLUSH:
                yield summed()
                waiting, size = [], 0

        yield from _packed(batches, make, bits)
        if size:
            yield from _packed([pa.RecordBatch.from_arrays([pa.array([""])], names=["text"])], lambda _: [summed()], bits)

    def merge(table: pa.Table) -> pa.Table:
        *columns, n = _unpacked(table.column("blob"), (np.uint64,) * len(names) + (np.uint32,))
        key = whole(columns)
        order = np.argsort(key)
        columns = [c[order] for c in columns]
        start = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))
        total = np.add.reduceat(n[order].astype(np.int64), start)
        keep = total >= least
        start, total = start[keep], total[keep]
        own = [*(pa.array(c[start].view(np.int64)) for c in columns), pa.array(total), pa.nulls(len(start), pa.int32()), pa.nulls(len(start), pa.binary())]
        if not ends:
            return pa.table(own, names=[*names, "n", "b", "high"])
        high = (key[order[start]] >> np.uint64(32)).astype(np.uint32).tobytes()
        end = [*(pa.nulls(1, pa.int64()) for _ in range(len(columns) + 1)), table.column("b")[:1].combine_chunks(), pa.array([high], pa.binary())]
        return pa.concat_tables([pa.table(x, names=[*names, "n", "b", "high"]) for x in (own, end)])

    packed = documents.select("text").mapInArrow(run, "b int,blob binary")
    return packed.groupBy("b").applyInArrow(merge, ",".join(f"{x} long" for x in (*names, "n")) + ",b int,high binary")


@dataclass
class Model:
    total: int
    kinds: int
    table: DataFrame  # (h, c) of all training words
    levels: list[DataFrame]  # of each depth: (h, n, p, v, lead, first, size, weight, last, parent)
    kept: int = 0  # rows of the levels

    @property
    def bits(self) -> int:
        """Buckets of packed rows, as a power of two: about a million tokens each."""
        return max(8, (self.total // 1_000_000).bit_length())

    @property
    def frequent(self) -> float:
        return max(float(LEAST), FREQUENT * self.total)


def learn(documents: DataFrame, depth: int = DEPTH) -> Model:
    """Counts all repeated grams of the training part and decides which contexts are retained."""
    spark = documents.sparkSession
    learned = documents.where(crc_mod("doc_id", FOLDS) != HELD_OUT)
    table = materialise(_counts(learned, lambda text: (tokens(text)[0],), ("h",), WORD_BUCKETS, 1).select("h", F.col("n").alias("c")), "words")
    total, kinds = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    model = Model(int(total), int(kinds), table, [])
    below = table.where(F.col("c") >= LEAST).select("h", F.col("c").alias("n"), ((F.col("c") + 1) / F.lit(float(total + kinds + 1))).alias("p"))
    count = below.count()
    seen = bitmap_of(below, count)
    for d in range(depth):
        if not count:
            break
        shared = spark.sparkContext.broadcast(seen)

        def transitions(text, d=d, shared=shared):
            value, row = tokens(text)
            key, there = grams(value, row, d + 1)[-1]
            there = there & in_bitmap(shared.value, key)
            at = np.flatnonzero(there[1:] & there[:-1] & (row[1:] == row[:-1]))
            return key[at], key[at + 1]

        counted = materialise(_counts(learned, transitions, ("first", "last"), model.bits, LEAST, d + 1 < depth), "counted")
        rows = counted.where("n is not null").drop("b", "high").join(below.select(F.col("h").alias("last"), F.col("p").alias("parent")).hint("shuffle_hash"), "last")
        rows = rows.join(below.select(F.col("h").alias("first"), F.col("n").alias("size")).hint("shuffle_hash"), "first")
        # all by one key: the join's shuffle serves both windows
        context = Window.partitionBy("first")
        rows = rows.withColumn("stored", F.sum("n").over(context)).withColumn("types", F.count(F.lit(1)).over(context))
        rows = rows.withColumn("weight", F.col("stored") / (F.col("size") + F.col("types"))).withColumn("own", F.col("weight") * F.col("n") / F.col("stored") + (1 - F.col("weight")) * F.col("parent"))
        gain = 2 * F.sum(F.col("n") * F.log(F.col("own") / F.col("parent"))).over(context) + 2 * (F.col("size") - F.col("stored")) * F.log1p(-F.col("weight"))
        rows = rows.withColumn("retained", gain > F.col("types") + 3 * F.sqrt(2.0 * F.col("types")))
        p = F.when(F.col("retained"), F.col("own")).otherwise(F.col("parent"))
        # what the next depth and the scores need; the rest only for the frequent part, and of a context's rows in one
        retained, often = F.col("retained"), F.col("n") >= model.frequent
        v = F.log10("own") - F.log10(1 - F.col("weight")) - F.log10("parent")
        lead = retained & (F.col("last") == F.min("last").over(context))
        p = F.when(retained, F.col("own")).otherwise(F.col("parent"))
        some = lambda test, *names: [F.when(test, F.col(x)).alias(x) for x in names]
        rows = rows.withColumn("lead", lead).select(
            F.xxhash64("first", "last").alias("h"), "n", (F.when(often, p) if d + 1 == depth else p).alias("p"), F.when(retained, v).cast("float").alias("v"), "lead",
            *some(F.col("lead") | often, "first", "size"), *some(retained & (F.col("lead") | often), "weight"), *some(often, "last"), *some(retained & often, "parent"),
        )
        level, count = materialise_with(rows, "level", F.count(F.lit(1)))
        if d + 1 < depth:
            # the level's grams are all that were counted: parts of a gram that occurs LEAST times do so too
            seen = bitmap_of_blobs(counted.where("n is null").select("b", "high"), count, model.bits, lambda blob, _: np.frombuffer(blob, np.uint32))
        discard(counted)
        model.levels.append(level)
        model.kept += count
        below = level.select("h", "n", "p")
    return model


def additions(model: Model) -> DataFrame:
    """(b, blob): what grams add to a score, in one entry or more for each, packed by buckets of their keys; frequent ones have buckets of their own, beyond those of the others."""
    least, bits = max(1.0, FREQUENT * model.total), model.bits

    def entries(h, often, v, c):
        key = h.to_numpy().view(np.uint64)
        return key >> np.uint64(1) | often.astype(np.uint64) << np.uint64(63), key.view(np.uint8).reshape(-1, 8)[:, :7], v, c

    def of_words(part):
        c = part.column(1).to_numpy()
        yield entries(part.column(0), c >= least, np.zeros(len(c), np.float32), c)

    def of_grams(part):
        """Each row adds what its gram gains; the first of a context also what the context leaves to its parent."""
        leads = part.filter(part.column(3).is_valid())
        for rows, at in ((part, 0), (leads, 3)):
            h, often, v = rows.columns[at : at + 3]
            yield entries(h, often.to_numpy(zero_copy_only=False).astype(bool), v.to_numpy(zero_copy_only=False), np.zeros(len(h), np.int64))

    packed = lambda rows, make: rows.mapInArrow(lambda batches: _packed(batches, make, bits + 1), "b int,blob binary")
    lead = lambda x: F.when(F.col("lead"), x)
    left = F.log10(1 - F.col("weight")).cast("float")
    grams = [level.where("v is not null").select("h", (F.col("n") >= least).alias("often"), "v", lead(F.col("first")).alias("first"), lead(F.col("size") >= least).alias("wide"), lead(left).alias("left")) for level in model.levels]
    out = packed(model.table.select("h", "c"), of_words)
    return out.union(packed(reduce(DataFrame.union, grams), of_grams)) if grams else out


def _added(blobs: pa.ChunkedArray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts of words, sums of what is added) of packed additions, by key."""
    low, v, c = _unpacked(blobs, (_LOW, np.float32, np.int64))
    h = _whole(low, top)
    order = np.argsort(h)
    h, c, v = h[order], c[order], v[order].astype(np.float64)
    start = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), h[1:] != h[:-1]]))
    return h[start], np.maximum.reduceat(c, start) if len(h) else c, np.add.reduceat(v, start) if len(h) else v


def _sorted(table: pa.Table, *names: str) -> list[np.ndarray]:
    columns = [table.column(x).to_numpy() for x in names]
    columns[0] = columns[0].view(np.uint64)
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def train(documents: DataFrame, depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """(the frequent part of the tree, the table (h, c) of all training words' counts)."""
    model = learn(documents, depth)
    words, counts = _sorted(model.table.where(F.col("c") >= max(1.0, FREQUENT * model.total)).toArrow(), "h", "c")
    tree = Tree(model.total, model.kinds, words, counts.astype(np.float64))
    below, word = words, np.arange(len(words))  # grams of the last length, and the index of the last word of each
    packed = word.copy()
    for level in model.levels:
        share = F.coalesce((F.col("p") - (1 - F.col("weight")) * F.col("parent")) / F.col("weight"), F.lit(0.0)).alias("share")
        frequent = level.where(F.col("n") >= model.frequent).select("h", "first", "last", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"), share)
        h, first, last, size, weight, share = _sorted(frequent.toArrow(), "h", "first", "last", "size", "weight", "share")
        lead, tail = find(below, first.view(np.uint64)), find(below, last.view(np.uint64))
        leads, at = np.unique(lead, return_index=True)
        order = np.argsort(packed[leads])
        leads, at = leads[order], at[order]
        place = np.zeros(len(below), np.int64)
        place[leads] = np.arange(len(leads))
        tree.contexts.append(packed[leads])
        tree.sizes.append(size[at].astype(np.float64))
        tree.weight.append(weight[at])
        below, word, packed = h, word[tail], place[lead] << _WORD_BITS | word[tail]
        order = np.argsort(packed)
        tree.keys.append(packed[order])
        tree.share.append(share[order])
    return tree, model.table


def _hot(packed: DataFrame, bits: int) -> tuple[np.ndarray, ...]:
    """(words, logarithms of counts plus one, additions; grams, additions) of what is broadcast: at most 1 / FREQUENT a length."""

    def merge(table: pa.Table) -> pa.Table:
        h, c, v = _added(table.column("blob"), table.column("b")[0].as_py() >> bits - 8)
        return pa.table({"h": h.view(np.int64), "c": c, "v": v})

    with writing(packed.sparkSession):
        h, c, v = _sorted(packed.groupBy("b").applyInArrow(merge, "h long,c long,v double").toArrow(), "h", "c", "v")
    word = c > 0
    return h[word], np.log10(c[word] + 1.0), v[word], h[~word], v[~word]


def score(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    model = learn(documents, depth)
    bits = model.bits

    rare, bucket = F.col("b") < 1 << bits, F.col("b").bitwiseAND((1 << bits) - 1).alias("b")
    packed, size = materialise_with(additions(model), "packed", F.sum(F.octet_length("blob")))
    discard(model.table, *model.levels)
    # what is asked for: only what adds something to a score, and is not broadcast
    table = packed.where(rare)
    seen = bitmap_of_blobs(packed.select(bucket, "blob"), (size or 0) // _ENTRY, bits, lambda blob, top: (_whole(np.frombuffer(blob, _LOW, blob.size // _ENTRY), top) >> np.uint64(32)).astype(np.uint32))
    words, logs, left, keys, gains = _hot(packed.where(~rare).select(bucket, "blob"), bits)
    shared = documents.sparkSession.sparkContext.broadcast((Places(words), logs, left, Places(keys), gains, seen))
    length, unit = len(model.levels) + 1, float(np.log10(model.total + model.kinds + 1)) if model.total else 0.0
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))

    def parts_of(part):
        """Of a slice: (row ids, and by document tokens, known tokens, both sums of what is broadcast; row and key of what is asked)."""
        words, logs, left, keys, gains, seen = shared.value
        rows = part.num_rows
        value, row = tokens(part.column(2))
        word = words.of(value)
        known = word >= 0
        base = np.full(len(value), -unit)
        base[known] += logs[word[known]]
        more = base.copy()
        more[known] += left[word[known]]
        at = np.flatnonzero(~known)
        at = at[in_bitmap(seen, value[at])]  # others stand in no training text
        asked = [(row[at], value[at])]
        for key, there in grams(value, row, length)[1:]:
            at = np.flatnonzero(there & in_bitmap(seen, key))
            hit = keys.of(key[at])
            more[at[hit >= 0]] += gains[hit[hit >= 0]]
            at = at[hit < 0]
            asked.append((row[at], key[at]))
        sums = [np.bincount(row, x, rows) for x in (base, more)]
        ints = [np.bincount(row, x, rows).astype(np.int64) for x in (np.ones(len(row)), known.astype(float))]
        return (*ints, *sums), tuple(np.concatenate(x) for x in zip(*asked, strict=True))

    def run(batches):
        """Rows (b, blob) of what is asked, and rows (rid, ...) of the documents' own sums."""
        own, first = [], np.zeros(1, np.int64)

        def make(part):
            rid = part.column(0).to_numpy()
            first[0] = rid[0] & ~_TASK
            if rid[-1] - first[0] >= 1 << 32:
                raise ValueError("a task reads 2^32 documents or more; read them in smaller parts")
            sums, (row, key) = parts_of(part)
            own.append((part.column(0), part.column(1), *map(pa.array, sums)))
            # the bucket says the highest byte, the task the highest part of the row id
            yield key, key.view(np.uint8).reshape(-1, 8)[:, :7], (rid - first[0]).astype(np.uint32)[row]

        schema = arrow_schema(ddl)
        for packed in _packed(batches, make, bits, first.tobytes):
            yield pa.RecordBatch.from_arrays([*packed.columns, *(pa.nulls(packed.num_rows, f.type) for f in list(schema)[2:])], schema=schema)
            while own:
                yield _own(own.pop(), schema)
        while own:
            yield _own(own.pop(), schema)

    def _own(columns, schema):
        n = len(columns[0])
        b = columns[0].to_numpy() & ((1 << bits) - 1)  # they ride along, spread over the buckets
        return pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.nulls(n, pa.binary()), *columns], schema=schema)

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        """What the table's rows of a bucket add to the documents that ask, and the documents' own rows as they are."""
        names = ["rid", "doc_id", "n_tokens", "known", "base", "score"]
        own = asked.filter(pa.compute.is_null(asked.column("blob"))).drop_columns(["b", "blob"]).rename_columns(names)
        if not asked.num_rows:
            return own
        top = asked.column("b")[0].as_py() >> bits - 8
        h, count, gain = _added(held.column("blob"), top)
        low, rid = _asked(asked.column("blob").drop_null())
        at = Places(h).of(_whole(low, top))
        rid, at = rid[at >= 0], at[at >= 0]
        if not len(at):
            return own
        more = np.log10(count + 1.0)  # 0 for grams
        rids, place = np.unique(rid, return_inverse=True)
        known = np.bincount(place, count[at] > 0, len(rids)).astype(np.int64)
        none = pa.nulls(len(rids), pa.int64())
        made = [rids, none, none, known, np.bincount(place, more[at], len(rids)), np.bincount(place, (more + gain)[at], len(rids))]
        return pa.concat_tables([own, pa.table([pa.array(x) for x in made], names=names)])

    ddl = "b int,blob binary,rid long,doc_id long,n_tokens long,n_known long,base double,score double"
    share = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS))
    rows_of = lambda k: documents.where(share == k).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)

    # a round's questions and answers are gone from disk before the next one asks
    rounds = []
    for k in range(ROUNDS):
        answers = rows_of(k).groupBy("b").cogroup(table.groupBy("b")).applyInArrow(answer, "rid long,doc_id long,n_tokens long,known long,base double,score double")
        made = answers.groupBy("rid").agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum("known").alias("n_known"),
            F.sum("base").alias("base_score"),
            F.sum("score").alias("score"),
        )
        rounds.append(materialise(made, "scores"))
    discard(packed)
    out = reduce(DataFrame.unionByName, rounds)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
