"""Average-linkage clusters with a source rule, exact to the tie.

Nothing is more similar than copies (vectors that are equal up to a power of two), so these are gathered before any
pair is made: a group of copies is one row with a weight, however many they are, and its members are numbered by ranges
of their ids when the result is written out. A merge needs a pair at the threshold or above, so clusters lie inside the
components of the graph of such pairs; each component is clustered on its own, by the sequential rules, in one task. A
component that is too large for one task goes through rounds of merges over tables until it has fallen apart or is small
enough (see ``merging``); the task goes on from there. That task keeps one matrix of mean similarities and the best partner of each row, so a merge costs a row, not the
matrix. The matrix is near (a matrix product, then weighted means); whoever may be the next best pair is computed
exactly, in member order, before it is compared, so ties fall as they would if everything were recomputed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinweave.functions.vectors import cosine, has_features
from twinweave.operators.checkpoints import materialise, materialise_with
from twinweave.operators.cosines import exact_cosines, exact_means, magnitudes
from twinweave.operators.graph import components
from twinweave.operators.merging import begun, bucket, each_component, opened
from twinweave.operators.similarity import similar_pairs

#: Clusters of a component that one task goes on with (9 bytes for each pair of them, three times that while it begins); larger ones go through rounds of merges first.
LARGEST_COMPONENT = 6_000
#: What a near mean may be off by, several times over.
MARGIN = 1e-6
_BUCKET = 14


def near_similarities(vectors: np.ndarray) -> np.ndarray:
    """Symmetric cosines by a matrix product; 0 for zero vectors."""
    size = magnitudes(vectors)
    unit = vectors.astype(np.float64) / np.where(size == 0, 1.0, size)[:, None]
    return unit @ unit.T


def cluster_matrix(sims: np.ndarray, sources: list[set] | list | None, threshold: float, exact: Callable | None = None, weights: np.ndarray | None = None, start: list[list[int]] | None = None) -> list[list[int]]:
    """Member lists in slot order; members in the order in which they were merged.

    ``sims`` is a symmetric matrix of similarities. With ``exact``, a function that makes exact means, it need only
    be near, and is used up. Rows that share a source are never merged; without sources, any may be. With ``start``, rows
    are clusters already, of these members.
    """
    n = len(sims)
    members: list[list[int]] = [[i] for i in range(n)] if start is None else [[*m] for m in start]
    if n < 2:
        return members
    near = sims if exact else sims.copy()
    if exact is None:

        def exact(one, others):
            return np.array([np.cumsum(sims[np.ix_(one, x)].reshape(-1))[-1] / (len(one) * len(x)) for x in others])

    size = np.ones(n) if weights is None else weights.astype(float)
    near[np.isnan(near)] = -np.inf
    np.fill_diagonal(near, -np.inf)
    if sources is not None:
        rows_of: dict = {}
        for i, own in enumerate(sources):
            for s in own if isinstance(own, (set, frozenset)) else (own,):
                rows_of.setdefault(s, []).append(i)
        for rows in rows_of.values():
            if len(rows) > 1:
                near[np.ix_(rows, rows)] = -np.inf

    known = np.zeros((n, n), bool)  # exact entries, above the diagonal
    settled = np.full(n, np.inf)  # entries of a row from here on are exact
    best, at = np.full(n, -np.inf), np.zeros(n, np.int64)

    def look(i: int) -> None:
        """The best partner of a row among later ones; the first of equals."""
        if i + 1 < n:
            at[i] = k = i + 1 + int(np.argmax(near[i, i + 1 :]))
            best[i] = near[i, k]

    def settle(low: float) -> bool:
        """Make exact what stands at ``low`` or above; whether there was any."""
        changed = False
        for i in np.flatnonzero((best >= low) & (settled > low)):
            todo = i + 1 + np.flatnonzero((near[i, i + 1 :] >= low) & ~known[i, i + 1 :])
            settled[i] = low
            if len(todo):
                made = exact(members[i], [members[k] for k in todo])
                near[i, todo] = near[todo, i] = np.where(np.isnan(made), -np.inf, made)
                known[i, todo] = changed = True
                look(i)
        return changed

    for i in range(n):
        look(i)
    while best.max() >= threshold - MARGIN and best.max() > -1.0 - MARGIN:
        while settle(best.max() - MARGIN):
            pass
        i = int(np.argmax(best))
        j, top = int(at[i]), best[i]
        if not top > -1.0 or top < threshold:
            break
        row = (near[i] * size[i] + near[j] * size[j]) / (size[i] + size[j])
        row[[i, j]] = -np.inf
        members[i] += members[j]
        members[j] = []
        size[i] += size[j]
        near[i], near[:, i] = row, row
        near[j] = near[:, j] = -np.inf
        known[i] = known[:, i] = False
        settled[i], best[j] = np.inf, -np.inf
        settled[:i] = np.where(row[:i] >= settled[:i], np.nextafter(row[:i], np.inf), settled[:i])
        for k in np.flatnonzero((best[:j] > -np.inf) & ((at[:j] == i) | (at[:j] == j))):
            look(int(k))
        look(i)
        first = np.flatnonzero((row[:i] > best[:i]) | ((row[:i] == best[:i]) & (at[:i] > i)))
        best[first], at[first] = row[first], i
    return [m for m in members if m]


def copy_key(vector: np.ndarray) -> bytes | None:
    """What vectors have in common that are equal up to a power of two; none for vectors without a direction."""
    most = np.abs(vector).max() if len(vector) else 0.0
    if not (np.isfinite(most) and most > 0):
        return None
    return (vector / np.float32(2.0 ** np.floor(np.log2(most)))).tobytes()


def copies(vectors: np.ndarray, sources: list | None) -> list[list[int]]:
    """Rows in groups of copies, in order; a group that repeats a source is left as single rows.

    Nothing is more similar than copies, so they are the first to be merged, in order.
    """
    found: dict[bytes, list[int]] = {}
    for i, v in enumerate(vectors):
        found.setdefault(copy_key(v) or b"%d" % i, []).append(i)
    out = []
    for rows in found.values():
        alike = sources is None or len({sources[i] for i in rows}) == len(rows)
        out += [rows] if alike else [[i] for i in rows]
    return sorted(out)


def cluster_weighted(vectors: np.ndarray, sources: list[set] | None, weights: np.ndarray, threshold: float, start: list[list[int]] | None = None) -> list[list[int]]:
    """Member lists of the clusters of float32 vectors, each of which stands for as many items as its weight says.

    With ``start``, merging goes on from these clusters, and sources are theirs.
    """
    if start is None or len(start) == len(vectors):
        return cluster_matrix(near_similarities(vectors), sources, threshold, exact_means(vectors, weights), weights, start)
    size = magnitudes(vectors)
    units = vectors.astype(np.float64) / np.where(size == 0, 1.0, size)[:, None]
    counts = np.array([weights[m].sum() for m in start])
    means = np.stack([weights[m] @ units[m] for m in start]) / counts[:, None]
    return cluster_matrix(means @ means.T, sources, threshold, exact_means(vectors, weights), counts, start)


def cluster_vectors(vectors: np.ndarray, sources: list | None, threshold: float) -> list[list[int]]:
    """Member lists of the clusters of float32 vectors; copies are merged beforehand if the threshold lets them."""
    groups = copies(vectors, sources) if threshold <= 1.0 - MARGIN else [[i] for i in range(len(vectors))]
    held = None if sources is None else [{sources[i] for i in g} for g in groups]
    found = cluster_weighted(vectors[[g[0] for g in groups]], held, np.array([len(g) for g in groups], float), threshold)
    return [[i for m in members for i in groups[m]] for members in found]


def mean_similarity(vectors: np.ndarray) -> float:
    """Mean cosine over pairs of members in their order; 1 for a single member. Pairs are made a few rows at a time."""
    n = len(vectors)
    if n < 2:
        return 1.0
    total = 0.0
    for i in range(n - 1):
        total = np.cumsum(np.concatenate([[total], exact_cosines(np.broadcast_to(vectors[i], (n - i - 1, vectors.shape[1])), vectors[i + 1 :])]))[-1]
    return float(total / (n * (n - 1) // 2))


def weighted_mean_similarity(vectors: np.ndarray, weights: np.ndarray) -> float:
    """Mean cosine over pairs of items, of which each vector stands for several."""
    if (weights == 1).all():
        return mean_similarity(vectors)
    own = weights * (weights - 1) / 2
    total = float((own * exact_cosines(vectors, vectors)).sum())
    for i in range(len(vectors) - 1):
        total += float((weights[i] * weights[i + 1 :] * exact_cosines(np.broadcast_to(vectors[i], vectors[i + 1 :].shape), vectors[i + 1 :])).sum())
    items = weights.sum()
    return total / (items * (items - 1) / 2)


_HELD = ["item_idx", "source_id", "copy_key", "features"]


def held_features(items: DataFrame) -> DataFrame:
    """(item_idx, source_id, copy_key, features) of the items with features, written once; a frame that was written here stays as it is."""
    if "written_to" in items.__dict__ and items.columns == _HELD:
        return items
    rows = items.where(has_features("features")).select("item_idx", F.col("source_id").cast("string").alias("source_id"), F.col("features").cast("array<float>").alias("features"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [copy_key(np.array(v, np.float32)) for v in batch.column(2).to_numpy(zero_copy_only=False)]
            keys = [hashlib.blake2b(k, digest_size=16).digest() if k else None for k in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), batch.column(2)], names=_HELD)

    return materialise(rows.mapInArrow(run, "item_idx long, source_id string, copy_key binary, features array<float>"), "features")


@dataclass
class Gathered:
    """Items with their copies drawn together.

    ``rows`` is (item_idx, source_id, weight, features), one row for each group of copies (the least item stands for it)
    and for each other item; ``copies`` is (item_idx, source_id, stands_for_it, place) of the members of groups, or
    none if there are none. ``count`` is the number of rows, where it is known.
    """

    rows: DataFrame
    copies: DataFrame | None = None
    count: int | None = None


def gathered(held: DataFrame, threshold: float, constrained: bool = True) -> Gathered:
    """Copies drawn together, unless the threshold may keep them apart. A group that repeats a source stays as single items if sources are kept apart.

    Rows are counted by key and source first, so a vector of very many copies is few rows before anything is shuffled
    by it; that a part of the rows are copies of one is a skewed join, which is split.
    """
    alone = Gathered(held.select("item_idx", "source_id", F.lit(1).cast("long").alias("weight"), "features"))
    if threshold > 1.0 - MARGIN:
        return alone
    by_source = held.where("copy_key is not null").groupBy("copy_key", "source_id").agg(F.count(F.lit(1)).alias("n"), F.min("item_idx").alias("low"))
    groups = by_source.groupBy("copy_key").agg(F.sum("n").alias("weight"), F.min("low").alias("stands_for_it"), F.max("n").alias("most")).where("weight > 1")
    groups, n = materialise_with(groups.where("most = 1") if constrained else groups, "copies", F.count(F.lit(1)))
    if not n:
        return alone
    members = held.select("item_idx", "source_id", "copy_key").join(groups, "copy_key").select("item_idx", "source_id", "stands_for_it", "weight")
    members = materialise(ranked(members, "item_idx", "place", within="stands_for_it").withColumn("place", (F.col("place") - 1)), "copies")
    # a group of several sources shares its one source with nobody
    joined = held.join(members.select("item_idx", "stands_for_it", F.col("weight").alias("w")), "item_idx", "left").where("w is null or stands_for_it = item_idx")
    shown = F.when(F.col("w").isNull(), F.col("source_id")).otherwise(F.concat(F.lit("\0"), F.col("item_idx").cast("string")))
    rows, n = materialise_with(joined.select("item_idx", shown.alias("source_id"), F.coalesce("w", F.lit(1)).cast("long").alias("weight"), "features"), "gathered", F.count(F.lit(1)))
    return Gathered(rows, members, n)


def _contested(drawn: Gathered) -> DataFrame:
    """(item_idx, sources): of each row, the sources that other rows have too; only these can keep rows apart."""
    single = drawn.rows.where("weight = 1").select("item_idx", "source_id")
    every = single if drawn.copies is None else single.unionByName(drawn.copies.select(F.col("stands_for_it").alias("item_idx"), "source_id"))
    several = every.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("source_id").alias("s"))
    return every.join(several, F.col("source_id").eqNullSafe(F.col("s"))).groupBy("item_idx").agg(F.collect_list(F.coalesce("source_id", F.lit("\0"))).alias("sources"))


def clusters(items: DataFrame, threshold: float, constrained: bool = True, pairs: DataFrame | None = None, drawn: Gathered | None = None) -> DataFrame:
    """(slot, member_pos, item_idx, average_similarity): every item with features in exactly one cluster.

    Features are computed once: what they come from runs for one written table. ``pairs`` are those of the gathered rows.
    """
    drawn = drawn or gathered(held_features(items), threshold, constrained)
    if pairs is None:
        pairs = materialise(similar_pairs(drawn.rows, threshold, constrained, rows=drawn.count), "pairs")
    placed = components(pairs)
    sourced = drawn.rows.join(_contested(drawn), "item_idx", "left") if constrained else drawn.rows.withColumn("sources", F.lit(None).cast("array<string>"))
    spots = placed.withColumns({"slot": F.col("item_idx"), "place": F.lit(0).cast("long")})
    large = placed.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGEST_COMPONENT).select("component_id")
    if not large.isEmpty():
        inside = placed.join(large, "component_id", "left_semi").select("item_idx")
        merged = begun(sourced.join(inside, "item_idx", "left_semi"), pairs, threshold, LARGEST_COMPONENT, cluster_weighted)
        spots = spots.join(large, "component_id", "left_anti").unionByName(merged)
    grouped = sourced.join(spots, "item_idx")

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for part in each_component(group):
            ids = part["item_idx"].to_numpy()
            vectors, weights, start, sources = opened(part)
            for members in cluster_weighted(vectors, sources if constrained else None, weights, threshold, start):
                mean = weighted_mean_similarity(vectors[members], weights[members])
                before = 0
                for m in members:
                    rows.append((int(ids[members[0]]), before, int(ids[m]), int(weights[m]), mean))
                    before += int(weights[m])
        return pd.DataFrame(rows, columns=["slot", "member_pos", "item_idx", "weight", "average_similarity"])

    ddl = "slot long, member_pos int, item_idx long, weight long, average_similarity double"
    # small components share a call: each call costs milliseconds
    several = bucket(drawn.rows.count() if drawn.count is None else drawn.count)
    found = grouped.select(several, "component_id", "item_idx", "slot", "place", "weight", "features", "sources").groupBy("bucket").applyInPandas(cluster, ddl)
    # copies are as similar as a vector is to itself
    own = F.when(F.col("weight") > 1, cosine("features", "features")).otherwise(F.lit(1.0))
    alone = drawn.rows.join(placed, "item_idx", "left_anti").select(F.col("item_idx").alias("slot"), F.lit(0).alias("member_pos"), "item_idx", "weight", own.alias("average_similarity"))
    rows = found.unionByName(alone)
    columns = ["slot", "member_pos", "item_idx", "average_similarity"]
    if drawn.copies is None:
        return rows.select(*columns)
    rows = materialise(rows, "slots")
    several = rows.where("weight > 1").withColumnRenamed("item_idx", "stands_for_it").join(drawn.copies.select("item_idx", "stands_for_it", "place"), "stands_for_it")
    several = several.withColumn("member_pos", (F.col("member_pos") + F.col("place")).cast("int"))
    return rows.where("weight = 1").select(*columns).unionByName(several.select(*columns))


def ranked(df: DataFrame, key: str, name: str, weight: str | None = None, within: str | None = None) -> DataFrame:
    """Add the running count (or the running sum of ``weight``) of rows in order of a whole-number key, of all or within the rows of a column's value.

    Keys are counted by ranges of 2^14 first, so only one row for each range meets in one task.
    """
    step = F.lit(1) if weight is None else F.col(weight).cast("long")
    by = [within] if within else []
    cut = df.withColumn("__range", F.shiftright(key, _BUCKET))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy(*by, "__range").agg(F.sum(step).alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*by, "__range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(ranges, [*by, "__range"]).withColumn(name, F.col("__before") + F.sum(step).over(inside)).drop("__range", "__before")


def group_table(members: DataFrame) -> DataFrame:
    """(group_id, slot, name, item_count, average_similarity, is_duplicate), numbered in slot order.

    Duplicate groups are named by their own running number, single items by their id plus one.
    """
    groups = members.groupBy("slot").agg(F.count(F.lit(1)).alias("item_count"), F.first("average_similarity").alias("average_similarity"))
    groups = groups.withColumn("is_duplicate", F.col("item_count") > 1)
    groups = ranked(ranked(groups, "slot", "__n"), "slot", "__d", "is_duplicate")
    name = F.concat(F.lit("Group "), F.when(F.col("is_duplicate"), F.col("__d")).otherwise(F.col("__n")).cast("string"))
    return groups.select((F.col("__n") - 1).alias("group_id"), "slot", name.alias("name"), "item_count", "average_similarity", "is_duplicate")


def analyse(items: DataFrame, threshold: float, constrained: bool = True, pairs: DataFrame | None = None, drawn: Gathered | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, members): members have group_id in place of the slot. Both come from one written table."""
    members = materialise(clusters(items, threshold, constrained, pairs, drawn), "clusters")
    groups = materialise(group_table(members), "groups")
    return groups.drop("slot"), members.join(groups.select("slot", "group_id"), "slot").select("group_id", "member_pos", "item_idx", "average_similarity")
