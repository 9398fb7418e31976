"""Filter interaction audit by the multilinear extension (operator 11).

Which of several filters removes what depends on their order. Documents of a part (a value of ``source``) are counted by
the set of filters they fail. Let x_i be the chance that filter i is applied; the documents expected to be removed are
then a polynomial of degree one in every x_i,

    f(x) = sum over masks of n(mask) * (1 - product over i in mask of (1 - x_i)),

and everything that is asked for follows from its coefficients: at a corner (each x_i 0 or 1) it is the number removed by
these filters, so differences of corners are a filter's removals in an order; the integral of its partial derivative along
the diagonal is the filter's Shapley value, here by exact fractions, scaled by the number of orders. Labelled documents
have polynomials of their own.

How it runs: one narrow pass over the texts gives each row's part, a digest of the text and the filters A to D that it
fails (Arrow batches, whole texts). Filter E, an equal text under a smaller id, is decided by digests: rows are counted
by (digest, part, labels) with the least id of each, so a text of very many copies is a few rows before anything is
shuffled by its digest. Counts by part and mask are at most 32 rows a part, and each part's audit is made from its one
row of counts. No step gathers the documents of a key, and nothing passes through the driver.

Defined results: a null text is an empty one, a null part is the empty string. Texts are equal if their SHA-256 digests
are; words are told apart by 64-bit hashes. Rows that share an id are several documents; with equal texts, none has a
smaller id than the other. A null id is neither smaller nor larger than any, and has no labels. A document is good (toxic)
if any row of labels for its id says so. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import arrow_schema, slices, span_hashes, text_bytes, word_bounds
from twinweave.operators.checkpoints import materialise

#: The filters, as bits of a mask from the first on, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "#$%&*|"
_SYMBOL, _CAPITAL, _FIRST = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_CAPITAL[65:91] = True
_FIRST[0x80:0xC0] = False  # bytes that begin a code point


def _count(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def failures(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the filters A to D every text fails, as bits."""
    start, end, first = word_bounds(data, at)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    hashes = span_hashes(data, start, end)
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=len(n))
    fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * _count(_CAPITAL[data], at) > MOST_CAPITALS * _count(_FIRST[data], at), _count(_SYMBOL[data], at) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _marked(documents: DataFrame, part: str) -> DataFrame:
    """(doc_id, part, digest, mask) of every row."""
    ddl = "doc_id long,part string,digest binary,mask int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            for cut in slices(batch):
                data, at = text_bytes(cut.column(2))
                whole = memoryview(data)
                digests = [hashlib.sha256(whole[at[i] : at[i + 1]]).digest() for i in range(cut.num_rows)]
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(digests, pa.binary()), pa.array(failures(data, at), pa.int32())], schema=schema)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, ddl)


def mask_counts(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, and those labelled among them."""
    rows = materialise(_marked(documents, part), "marked")
    # rows of one id and text are counted first, then take the labels of the id; a null id has none and joins with nothing
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id")
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    keyed = rows.where("doc_id is not null").groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")).join(known, "doc_id", "left")
    zero = F.lit(0)
    cells = keyed.groupBy("digest", "part", "mask", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    # of the rows of a cell only those with its least id can be first of their text
    cells = materialise(cells.agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low")), "cells")
    least = cells.groupBy("digest").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    judged = cells.join(least, "digest", "left").withColumn("first", F.when(F.col("low") == F.coalesce("least", "low"), F.col("n_low")).otherwise(0))
    e = 1 << FILTERS.index("E")
    split = F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(e)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    told = judged.select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "s.mask", "s.n", "good", "toxic").where("n > 0")
    unnamed = rows.where("doc_id is null").select("part", "mask", F.lit(1).cast("long").alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    n = F.col("n")
    return told.unionByName(unnamed).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


# --- one part's polynomials


class Removals:
    """The polynomial of expected removals of a part; ``coefficients[s]`` belongs to the product of the variables in s."""

    def __init__(self, counts: list[int], filters: int = len(FILTERS)):
        self.filters, self.total = filters, sum(counts)
        self.coefficients = [0] * (1 << filters)
        for mask, n in enumerate(counts):
            s = mask
            while s and n:  # all non-empty subsets of the mask: 1 - product of (1 - x_i), multiplied out
                self.coefficients[s] += n if s.bit_count() % 2 else -n
                s = (s - 1) & mask
        self.corners = [self.at_corner(s) for s in range(1 << filters)]

    def at_corner(self, applied: int) -> int:
        """Documents removed if just these filters are applied."""
        total, s = 0, applied
        while s:
            total += self.coefficients[s]
            s = (s - 1) & applied
        return total

    def derivative(self, i: int) -> list[int]:
        """Coefficients, by powers of t, of the partial derivative to x_i at (t, ..., t)."""
        out = [0] * self.filters
        for s, c in enumerate(self.coefficients):
            if s >> i & 1:
                out[s.bit_count() - 1] += c
        return out

    def shapley(self, i: int) -> Fraction:
        """The integral of the derivative over t from 0 to 1."""
        return sum((Fraction(c, k + 1) for k, c in enumerate(self.derivative(i))), Fraction(0))


def audit_part(counts: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders and steps; counts are by mask."""
    k = len(FILTERS)
    every, valued, harmful = (Removals(x, k) for x in (counts, good, toxic))
    whole = (1 << k) - 1
    orders = factorial(k)
    shares = [every.shapley(i) * orders for i in range(k)]
    out = []
    for order in permutations(range(k)):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = every.corners[after] - every.corners[before]
            alone = every.corners[whole] - every.corners[whole ^ 1 << i]
            out.append((name, step, every.total - every.corners[after], removed, every.corners[1 << i] - removed, alone, valued.corners[after] - valued.corners[before], harmful.corners[after] - harmful.corners[before], int(shares[i])))
            before = after
    return out


def audit(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part."""
    ddl = "part string,filter_order string,step int," + ",".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    held = mask_counts(documents, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            for row in batch.to_pylist():
                by_mask = [[0] * (1 << len(FILTERS)) for _ in range(3)]
                for c in row["counts"]:
                    for counts, name in zip(by_mask, ("n", "good", "toxic"), strict=True):
                        counts[c["mask"]] += c[name]
                made = audit_part(*by_mask)
                columns = [[row["part"]] * len(made), *zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return held.mapInArrow(run, ddl)
