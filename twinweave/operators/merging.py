"""Rounds of average-linkage merges over tables, for components that no single task should cluster.

A mean of similarities is never above the larger of the two that it is made of, so two clusters that are each other's best
partner stay so until they are merged, whatever else is merged before: all such pairs are merged in one round, and the
result is that of merging them one by one, the best first. For the same reason a pair of clusters is at the threshold only
if parts of theirs were, so a table of such pairs (edges) is all that has to be kept. After a round, edges of merged
clusters get a near mean (the product of the clusters' mean unit vectors, which meet in a bounded number of blocks). Where
near means leave open who is best, or what the threshold says, the mean is made exactly, in member order.

The edges at the threshold may be very many (they grow with the square of the rows), while most are gone once the best have
been merged: a mean of many pairs is rarely at the threshold. Since no mean is above its parts, merges at a higher level come
before those below it, so rounds go down a few levels. At the first, edges are the pairs at it or above; at each further one,
the clusters of that time are compared anew, by products of their mean unit vectors (see ``pair_index``). The number of pairs
by similarity says where levels lie; they decide what is saved, never what is found.

Where rounds merge few (a large cluster takes up one neighbour in each), the strongest edges are taken by themselves: as many
as leave components small enough for one task each, which merges there all that is as similar as the weakest of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.operators.checkpoints import discard, materialise, materialise_with
from twinweave.operators.cosines import exact_means, magnitudes
from twinweave.operators.graph import components
from twinweave.operators.pair_index import indexed_pairs

#: What a near mean may be off by, several times over.
MARGIN = 1e-6
#: Blocks in which vectors meet edges: rows of one, and how many at least and at most.
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 1 << 15, 4, 16
#: Rounds after which components are looked at again.
LOOK_EVERY = 3
#: Pairs at the first level or above for each row at most, how many times as many each further level has, and levels lie at so many parts of 1.
PAIRS_EACH, RATIO, PARTS = 8, 4, 256
#: A level is left when a round merges fewer than one in so many clusters; what is left of it is found again at the next.
FEW_MERGED = 50
#: At the threshold, the strongest edges are taken by themselves after a round that merges fewer than one in so many clusters that have an edge.
SLOW = 12
#: Rows of components that one call of Python sees at least.
BUCKET_ROWS = 2048


def _nodes(rows: DataFrame) -> DataFrame:
    """(slot, n, m, total, sources): each row a cluster of weight n and m members, with the sum of its unit vectors."""

    def run(batches):
        for part in batches:
            v = np.stack(part["features"].to_numpy()).astype(np.float32) if len(part) else np.zeros((0, 0), np.float32)
            size = magnitudes(v)
            part["total"] = list(v.astype(np.float64) / np.where(size == 0, 1.0, size)[:, None] * part["n"].to_numpy()[:, None])
            part["m"] = np.ones(len(part), np.int64)
            yield part[["slot", "n", "m", "total", "sources"]]

    given = rows.select(F.col("item_idx").alias("slot"), F.col("weight").cast("double").alias("n"), "features", "sources")
    return given.mapInPandas(run, "slot long, n double, m long, total array<double>, sources array<string>")


def _candidates(edges: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """Edges that may be the best of an end (at_i, at_j), with ``open``: their mean has to be made exactly first; and how many are open."""
    ends = edges.select(F.explode(F.array("i", "j")).alias("u"), "s")
    best = ends.groupBy("u").agg(F.max("s").alias("best"))
    of = lambda k: best.select(F.col("u").alias(k), F.col("best").alias(f"best_{k}"))
    near = lambda k: F.col("s") >= F.col(f"best_{k}") - 2 * MARGIN
    some = edges.join(of("i"), "i").join(of("j"), "j").withColumns({"at_i": near("i"), "at_j": near("j")}).where("at_i or at_j").select("i", "j", "s", "known", "at_i", "at_j")
    some = materialise(some, "candidates")
    held = some.select(F.explode(F.array(F.struct(F.col("i").alias("u"), F.col("at_i").alias("at")), F.struct(F.col("j").alias("u"), F.col("at_j").alias("at")))).alias("e")).where("e.at")
    several = held.groupBy("e.u").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("u")
    of = lambda k: several.select(F.col("u").alias(k), F.lit(True).alias(f"several_{k}"))
    unsure = lambda k: F.col(f"at_{k}") & F.coalesce(f"several_{k}", F.lit(False))
    made = some.join(of("i"), "i", "left").join(of("j"), "j", "left").withColumn("open", ~F.col("known") & (unsure("i") | unsure("j") | (F.col("s") < threshold + MARGIN)))
    made, n = materialise_with(made.select("i", "j", "s", "at_i", "at_j", "open"), "candidates", F.count_if("open"))
    discard(some)
    return made, n or 0


def _exactly(candidates: DataFrame, members: DataFrame, rows: DataFrame) -> DataFrame:
    """The candidates, with exact means where they are open."""
    todo = candidates.where("open").select("i", "j")
    wanted = todo.select(F.explode(F.array("i", "j")).alias("slot")).distinct()
    held = materialise(members.join(wanted, "slot").join(rows.select("item_idx", "weight", "features"), "item_idx"), "members")
    side = lambda k: todo.withColumn("slot", F.col(k)).join(held, "slot").select("i", "j", F.lit(k == "j").alias("right"), "place", "weight", "features")

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["right", "place"], kind="stable")
        vectors = np.stack(group["features"].to_numpy()).astype(np.float32)
        cut = int((~group["right"]).sum())
        made = exact_means(vectors, group["weight"].to_numpy().astype(float))([*range(cut)], [[*range(cut, len(group))]])
        return pd.DataFrame({"i": group["i"].iloc[:1], "j": group["j"].iloc[:1], "exact": made})

    made = side("i").unionByName(side("j")).groupBy("i", "j").applyInPandas(mean, "i long, j long, exact double")
    return candidates.join(made, ["i", "j"], "left").withColumn("s", F.when(F.col("open"), F.col("exact")).otherwise(F.col("s"))).drop("exact")


def _mutual(candidates: DataFrame, threshold: float) -> DataFrame:
    """(i, j) of the pairs that are each other's best; of equals the first."""
    good = candidates.where((F.col("s") >= threshold) & (F.col("s") > -1.0) & ~F.isnan("s"))
    key = F.struct("s", (-F.col("i")).alias("a"), (-F.col("j")).alias("b"))
    one = lambda k: good.where(f"at_{k}").select(F.col(k).alias("u"), key.alias("key"))
    best = one("i").unionByName(one("j")).groupBy("u").agg(F.max("key").alias("key"))
    return best.groupBy("key").agg(F.count(F.lit(1)).alias("ends")).where("ends = 2").select((-F.col("key.a")).alias("i"), (-F.col("key.b")).alias("j"))


def _merged(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """Nodes after the merges; j goes into i."""
    side = lambda k: nodes.select(F.col("slot").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "m", "total", "sources")])
    both = merges.select("i", "j").join(side("i"), "i").join(side("j"), "j")
    none = F.array().cast("array<string>")
    made = both.select(
        F.col("i").alias("slot"),
        (F.col("n_i") + F.col("n_j")).alias("n"),
        (F.col("m_i") + F.col("m_j")).alias("m"),
        F.zip_with("total_i", "total_j", lambda x, y: x + y).alias("total"),
        F.array_union(F.coalesce("sources_i", none), F.coalesce("sources_j", none)).alias("sources"),
    )
    gone = merges.select(F.explode(F.array("i", "j")).alias("slot"))
    return nodes.join(gone, "slot", "left_anti").unionByName(made)


def _near(touched: DataFrame, nodes: DataFrame, blocks: int, threshold: float) -> DataFrame:
    """(i, j, s) of the touched pairs that may be at the threshold and share no source. A node goes to ``blocks`` units, an edge to one."""
    home = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    pair = lambda x, y: {"a": F.least(x, y), "b": F.greatest(x, y)}
    asked = touched.withColumns({"x": home("i"), "y": home("j")}).withColumns(pair("x", "y")).select("a", "b", "i", "j")
    ends = touched.select(F.explode(F.array("i", "j")).alias("slot")).distinct()
    mean = F.transform("total", lambda x: (x / F.col("n")).cast("float"))
    sent = nodes.join(ends, "slot", "left_semi").select("slot", mean.alias("mean"), "sources", home("slot").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.withColumns(pair("x", "y")).select("a", "b", "slot", "mean", "sources")

    def means(edges: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(edges):
            return pd.DataFrame({"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "s": np.zeros(0)})
        order = np.argsort(held["slot"].to_numpy())
        slots, vectors = held["slot"].to_numpy()[order], np.stack(held["mean"].to_numpy())[order].astype(np.float32)
        i, j = edges["i"].to_numpy(), edges["j"].to_numpy()
        p, q = np.searchsorted(slots, i), np.searchsorted(slots, j)
        s = np.concatenate([np.einsum("ij,ij->i", vectors[p[k : k + 8192]].astype(np.float64), vectors[q[k : k + 8192]].astype(np.float64)) for k in range(0, len(p), 8192)])
        keep = np.flatnonzero(s >= threshold - MARGIN)
        sources = held["sources"].to_numpy()[order]
        sets = {k: set(sources[k]) for k in {*p[keep].tolist(), *q[keep].tolist()} if sources[k] is not None and len(sources[k])}
        keep = np.array([k for k in keep if not (p[k] in sets and q[k] in sets and sets[p[k]] & sets[q[k]])], np.int64)
        return pd.DataFrame({"i": i[keep], "j": j[keep], "s": s[keep]})

    return asked.groupBy("a", "b").cogroup(sent.groupBy("a", "b")).applyInPandas(means, "i long, j long, s double")


def each_component(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The components of a bucket, each with its members in order."""
    group = group.sort_values(["component_id", "slot", "place"], kind="stable")
    cuts = np.flatnonzero(np.diff(group["component_id"].to_numpy())) + 1
    for low, high in pairwise([0, *cuts.tolist(), len(group)]):
        yield group.iloc[low:high]


def opened(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[set]]:
    """Vectors and weights of a component's members, the clusters as lists of rows, and the sources of each."""
    cuts = np.flatnonzero(np.diff(group["slot"].to_numpy())) + 1
    start = [x.tolist() for x in np.split(np.arange(len(group)), cuts)]
    held = [set() if s is None else set(s) for s in group["sources"]]
    return np.stack(group["features"].to_numpy()).astype(np.float32), group["weight"].to_numpy().astype(float), start, [set().union(*(held[i] for i in m)) for m in start]


def bucket(rows: int) -> Column:
    return F.pmod(F.xxhash64("component_id"), F.lit(max(1, rows // BUCKET_ROWS))).alias("bucket")


def _strongest(edges: DataFrame, live: int, level: float, largest: int) -> tuple[DataFrame, float] | None:
    """(components of the strongest edges, the similarity down to which these are all), if they can be small enough."""
    fine = 16 * PARTS
    found = edges.groupBy(F.floor(F.col("s") * fine).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("part")).collect()
    for bound in (live // 2, largest // 2):
        above, low = 0, None
        for part, n in found:
            above += n
            if above > bound:
                break
            low = max(level, part / fine)
        if low is None:
            continue
        inside = components(edges.where(F.col("s") >= low - 2 * MARGIN))
        if inside.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] <= largest:
            return inside, low
    return None


_GROWN = "item_idx long, before long, slot long, place long, n double, m long, total array<double>, sources array<string>, merges long"


def _taken(inside: DataFrame, low: float, members: DataFrame, rows: DataFrame, live: int, cluster: Callable) -> DataFrame:
    """Members of the clusters that grow in these components, with the slot before and after; the first of each has what ``_nodes`` says."""
    held = members.join(inside.withColumnRenamed("item_idx", "slot"), "slot").join(rows, "item_idx")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in each_component(group):
            vectors, weights, start, sources = opened(part)
            ids, slots = part["item_idx"].to_numpy(), part["slot"].to_numpy()
            of = {int(slots[m[0]]): s for m, s in zip(start, sources, strict=True)}
            size = magnitudes(vectors)
            units = vectors.astype(np.float64) / np.where(size == 0, 1.0, size)[:, None]
            for found in cluster(vectors, sources, weights, low, start):
                former = {int(x) for x in slots[found]}
                if len(former) < 2:
                    continue
                node = (float(weights[found].sum()), len(found), (weights[found] @ units[found]).tolist(), sorted(set().union(*(of[x] for x in former))), len(former) - 1)
                out += [(int(ids[m]), int(slots[m]), int(ids[found[0]]), k, *(node if k == 0 else (None,) * 5)) for k, m in enumerate(found)]
        return pd.DataFrame(out, columns=["item_idx", "before", "slot", "place", "n", "m", "total", "sources", "merges"]).astype({"m": "Int64", "merges": "Int64"})

    return held.select(bucket(live), "component_id", "item_idx", "slot", "place", "weight", "features", "sources").groupBy("bucket").applyInPandas(run, _GROWN)


def _levels(pairs: DataFrame, rows: int, threshold: float) -> list[float]:
    """Falling levels of similarity, the threshold last. The driver sees a row for each part of the similarities."""
    found = pairs.groupBy(F.floor(F.col("sim") * PARTS).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("part")).collect()
    out, above, bound = [], 0, PAIRS_EACH * rows
    for part, n in found:
        if above and above + n > bound:
            out.append((part + 1) / PARTS)
        above += n
        while above > bound:
            bound *= RATIO
    return [x for x in out if x > threshold] + [threshold]


def _compared(nodes: DataFrame, count: int, level: float) -> DataFrame:
    """(i, j, s, known) of the clusters whose near mean may be at the level and that share no source."""
    mean = F.transform("total", lambda x: (x / F.col("n")).cast("float"))
    held = nodes.select(F.col("slot").alias("item_idx"), F.to_json("sources").alias("source_id"), mean.alias("features"))
    return indexed_pairs(held, level, True, count, products=True).select("i", "j", F.col("sim").alias("s"), F.lit(False).alias("known"))


def begun(rows: DataFrame, pairs: DataFrame, threshold: float, largest: int, cluster: Callable) -> DataFrame:
    """(item_idx, slot, place, component_id): clusters after as many rounds as leave no component of more than ``largest`` clusters.

    ``rows`` is (item_idx, weight, features, sources), ``pairs`` their (i, j, sim) at the threshold or above. What is
    left to merge lies inside a component; a cluster without a partner is a component of its own. ``cluster`` is what a task
    does with the clusters of a component (``cluster_weighted``).
    """
    count = F.count(F.lit(1))
    rows = materialise(rows.select("item_idx", "weight", "features", "sources"), "rows")
    nodes, left = materialise_with(_nodes(rows), "nodes", count)
    members = materialise(rows.select("item_idx", F.col("item_idx").alias("slot"), F.lit(0).cast("long").alias("place")), "members")
    levels = _levels(pairs, left or 0, threshold)
    of = lambda k: rows.select(F.col("item_idx").alias(k), F.col("sources").alias(f"sources_{k}"))
    # rows that stand for copies have several sources, which the pairs do not know
    apart = pairs.where(F.col("sim") >= levels[0]).join(of("i"), "i").join(of("j"), "j").where(~F.coalesce(F.arrays_overlap("sources_i", "sources_j"), F.lit(False)))
    edges = materialise(apart.select("i", "j", F.col("sim").alias("s"), F.lit(True).alias("known")), "edges")
    live, done, slow = left, 0, False
    for level in levels:
        if level != levels[0]:
            discard(edges)
            edges = materialise(_compared(nodes, left, level), "edges")
            live = _ends(edges)
        while live:
            strong = _strongest(edges, live, level, largest) if slow else None
            if strong:
                grown, n = materialise_with(_taken(*strong, members, rows, live, cluster), "grown", F.sum("merges"))
                n = n or 0
                merges, slow = grown, False
            if not (strong and n):
                candidates, unsure = _candidates(edges, level)
                found = materialise(_exactly(candidates, members, rows), "candidates") if unsure else candidates
                merges, n = materialise_with(_mutual(found, level), "merges", count)
                discard(candidates, found)
                if not n:  # nothing more can be merged
                    edges = edges.limit(0)
                    break
                strong, slow = None, n * SLOW < live
            if strong:
                step = merges.select(F.col("before").alias("u"), F.col("slot").alias("to")).distinct()
                gone = step.select(F.col("u").alias("slot"))
                moved = members.join(gone, "slot", "left_anti").select("item_idx", "slot", "place").unionByName(merges.select("item_idx", "slot", "place"))
                made = nodes.join(gone, "slot", "left_anti").unionByName(merges.where("n is not null").select("slot", "n", "m", "total", "sources"))
            else:
                step = merges.select(F.explode(F.array("i", "j")).alias("u"), F.col("i").alias("to"))
                before = merges.join(nodes.select(F.col("slot").alias("i"), F.col("m").alias("before")), "i")
                moved = members.join(before.select(F.col("j").alias("slot"), "i", "before"), "slot", "left")
                moved = moved.select("item_idx", F.coalesce("i", "slot").alias("slot"), (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"))
                made = _merged(nodes, merges)
            moved, made = materialise(moved, "members"), materialise(made, "nodes")
            discard(members, nodes)
            members, nodes, left = moved, made, left - n
            if level > threshold and n * FEW_MERGED < left:
                slow = False
                discard(merges)
                break

            of = lambda k: step.select(F.col("u").alias(k), F.col("to").alias(f"to_{k}"))  # noqa: B023, E731
            mapped = edges.join(of("i"), "i", "left").join(of("j"), "j", "left")
            same = F.col("to_i").isNull() & F.col("to_j").isNull()
            x, y = F.coalesce("to_i", "i"), F.coalesce("to_j", "j")
            touched = materialise(mapped.where(~same).select(F.least(x, y).alias("i"), F.greatest(x, y).alias("j")).where("i < j").distinct(), "touched")
            blocks = max(LEAST_BLOCKS, min(MOST_BLOCKS, -(-live // BLOCK_ROWS)))
            kept = mapped.where(same).select("i", "j", "s", "known").unionByName(_near(touched, nodes, blocks, level).withColumn("known", F.lit(False)))
            kept = materialise(kept, "edges")
            discard(edges, touched, merges)
            edges, done = kept, done + 1
            live = _ends(edges)
            if level > threshold:
                continue
            if live <= largest:
                break
            if done % LOOK_EVERY == 0:
                inside = components(edges)
                most = inside.groupBy("component_id").agg(count.alias("n")).agg(F.max("n")).first()[0]
                if most <= largest:
                    break
    placed = components(edges)
    return members.join(placed.withColumnRenamed("item_idx", "slot"), "slot", "left").select("item_idx", "slot", "place", F.coalesce("component_id", "slot").alias("component_id"))


def _ends(edges: DataFrame) -> int:
    """How many clusters have an edge."""
    return edges.select(F.explode(F.array("i", "j")).alias("u")).distinct().count()
