"""Pairs by cosine similarity, exact.

Up to GRID_ROWS rows are dealt into blocks by a hash of their number; each pair of blocks is one group, in which a
matrix product finds candidates and the exact arithmetic (float products, one after another in double) decides. Beyond
that, blocks are made of vectors in like directions, and only pairs of blocks that can reach the threshold are made
(see ``pair_index``). Rows are the same either way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.functions.vectors import cosine, has_features
from twinweave.operators.cosines import MARGIN, exact_cosines, magnitudes
from twinweave.operators.pair_index import indexed_pairs

BLOCK_ROWS = 2048
#: Blocks at least, so that small tables are worked on side by side, and rows that a block then has at least.
LEAST_BLOCKS, LEAST_ROWS = 4, 128
#: Rows up to which the plain grid of blocks is cheaper than an index.
GRID_ROWS = 1 << 16


def check_lengths(items: DataFrame, features: str = "features") -> None:
    """An error if vectors differ in length: nothing can then be compared."""
    low, high = items.where(has_features(features)).agg(F.min(F.size(features)), F.max(F.size(features))).first()
    if low != high:
        raise ValueError(f"vectors differ in length: {low} and {high}")


def pairs_native(items: DataFrame, threshold: float | None = None, constrained: bool = False) -> DataFrame:
    """(i, j, sim) of all pairs i < j by a join on the order of the rows: for small tables and for checks."""
    side = lambda k: items.where(has_features("features")).select(F.col("item_idx").alias(k), F.col("features").alias(f"v{k}"), F.col("source_id").alias(f"s{k}"))
    ordered = F.col("i") < F.col("j")
    out = side("i").join(side("j"), ordered & (F.col("si") != F.col("sj")) if constrained else ordered).select("i", "j", cosine("vi", "vj").alias("sim"))
    return out if threshold is None else out.where(~F.isnan("sim") & (F.col("sim") >= threshold))


def similar_pairs(items: DataFrame, threshold: float, constrained: bool = True, block_rows: int = BLOCK_ROWS, rows: int | None = None) -> DataFrame:
    """(i, j, sim) with i < j and sim >= threshold; pairs of one source are left out if constrained; NaN is never similar."""
    held = items.where(has_features("features")).select("item_idx", F.col("source_id").cast("string").alias("source_id"), "features")
    n = held.count() if rows is None else rows
    if n > GRID_ROWS:
        return indexed_pairs(held, threshold, constrained, n)
    blocks = max(1, -(-n // block_rows), min(LEAST_BLOCKS, n // LEAST_ROWS))
    home = F.pmod(F.xxhash64("item_idx"), F.lit(blocks)).cast("int")
    dealt = held.withColumn("home", home).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("low", F.least("home", "other")).withColumn("high", F.greatest("home", "other")).drop("other")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item_idx", kind="stable")
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        left, right = group[group["home"] == low], group[group["home"] == high]
        none = pd.DataFrame({"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "sim": np.zeros(0)})
        if not len(left) or not len(right):
            return none
        x, y = (np.stack(g["features"].to_numpy()).astype(np.float32) for g in (left, right))
        unit = [v / np.where((m := magnitudes(v)) == 0, 1, m)[:, None] for v in (x, y)]
        near = unit[0] @ unit[1].T >= threshold - MARGIN
        a, b = left["item_idx"].to_numpy(), right["item_idx"].to_numpy()
        if low == high:
            near &= a[:, None] < b[None, :]
        if constrained:
            near &= left["source_id"].to_numpy()[:, None] != right["source_id"].to_numpy()[None, :]
        p, q = np.nonzero(near)
        sims = np.concatenate([exact_cosines(x[p[k : k + 8192]], y[q[k : k + 8192]]) for k in range(0, len(p), 8192)] or [np.zeros(0)])
        keep = sims >= threshold
        i, j = a[p[keep]], b[q[keep]]
        return pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "sim": sims[keep]})

    return dealt.groupBy("low", "high").applyInPandas(compare, "i long, j long, sim double")


def cross_pairs(left: DataFrame, right: DataFrame, threshold: float, constrained: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, sim) with sim >= threshold of a row of each table, i the smaller id; for a small table against a large one.

    Both are dealt into blocks; a row of one goes to every block of the other, so the large table is copied once for
    each block of the small one.
    """
    side = lambda t: t.where(has_features("features")).select("item_idx", F.col("source_id").cast("string").alias("source_id"), "features")
    sides = [side(left), side(right)]
    counts = [max(1, -(-x.count() // block_rows)) for x in sides]
    counts[1] = max(counts[1], min(LEAST_BLOCKS, sides[1].sparkSession.sparkContext.defaultParallelism))
    home = lambda n: F.pmod(F.xxhash64("item_idx"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = sides[0].withColumns({"own": F.lit(True), "low": home(counts[0])}).withColumn("high", every(counts[1]))
    dealt = dealt.unionByName(sides[1].withColumns({"own": F.lit(False), "high": home(counts[1])}).withColumn("low", every(counts[0])))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["own"]], group[~group["own"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "sim": np.zeros(0)})
        x, y = (np.stack(g["features"].to_numpy()).astype(np.float32) for g in (a, b))
        unit = [v / np.where((m := magnitudes(v)) == 0, 1, m)[:, None] for v in (x, y)]
        near = unit[0] @ unit[1].T >= threshold - MARGIN
        if constrained:
            near &= a["source_id"].to_numpy()[:, None] != b["source_id"].to_numpy()[None, :]
        p, q = np.nonzero(near)
        # the smaller id comes first, as it does among pairs of one table
        i, j = a["item_idx"].to_numpy()[p], b["item_idx"].to_numpy()[q]
        sims = np.concatenate([exact_cosines(x[p[k : k + 8192]], y[q[k : k + 8192]]) for k in range(0, len(p), 8192)] or [np.zeros(0)])
        keep = sims >= threshold
        return pd.DataFrame({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "sim": sims[keep]})

    return dealt.groupBy("low", "high").applyInPandas(compare, "i long, j long, sim double")


def new_pairs(fresh: DataFrame, earlier: DataFrame, threshold: float, constrained: bool = True, rows: int | None = None) -> DataFrame:
    """(i, j, sim) with i < j and sim >= threshold of a fresh row and any other; never of two earlier ones.

    Up to GRID_ROWS rows in all these are the pairs of the fresh rows and ``cross_pairs``. Beyond that, blocks of both tables
    would send each of them once for every block of the other, so both go through one index.
    """
    side = lambda t, was: t.where(has_features("features")).select("item_idx", F.col("source_id").cast("string").alias("source_id"), "features", F.lit(was).alias("earlier"))
    both = side(fresh, False).unionByName(side(earlier, True))
    n = both.count()
    if n > GRID_ROWS:
        return indexed_pairs(both, threshold, constrained, n)
    return similar_pairs(fresh, threshold, constrained, rows=rows).unionByName(cross_pairs(fresh, earlier, threshold, constrained))


def exact_copies(sim: Column | str, limit: float = 0.9999) -> Column:
    return (F.col(sim) if isinstance(sim, str) else sim) >= limit
