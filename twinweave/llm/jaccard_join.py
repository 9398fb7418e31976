"""N-gram Jaccard self-join by PartEnum signatures (operator 10).

Documents whose sets of word shingles have a Jaccard similarity of at least a limit are linked (4 words and
0.85 if no other ``Measure`` is given); the result gives every document the smallest id that links reach.
The steps:

1. Every text's set gets a fingerprint (two 64-bit sums) and a sketch (counts of hashes over 256 ranges).
   Equal sets form a class, represented by its smallest id; only classes are joined.
2. PartEnum signatures (see ``shingles.signatures``): linked sets of neighbouring size bands share one for
   certain. A bucket is the classes that share a signature. A task emits the signatures of a set once,
   whatever the number of its copies.
3. Star edges join each member of a bucket to the bucket's smallest. They are checked by the sketches' L1
   distance, a lower bound of the sets' difference, and what passes is verified exactly on the sets.
   Components of the verified links settle nearly all buckets of near copies without their pairs.
4. In buckets that still hold several components, members outside the largest one are compared with the
   others: pairs of blocks of about BLOCK members, finer sketches first, survivors verified exactly. No candidate
   is capped, so no link is lost; links inside a component need not be listed.

Shingles are known by 64-bit hashes of their words, and so are sets: exact means exact on these.

Cost: five scans of the text, one shuffle of the signatures (about half as many as shingles, 16 bytes each),
and small shuffles of candidates. Sets are rebuilt for candidates alone; a bitmap (at most 16 MB)
keeps most other documents out of that step. Nothing but that bitmap and round sums reaches the driver.

Defined results: null, empty and blank texts have n_shingles 0 and are linked with nothing (component_id is
the own doc_id); texts of fewer words than a shingle have one, the whole sequence; rows that share a doc_id
count as one document, which has all their links; a null doc_id gets the component of its equal sets, or
null; the order of rows does not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.common import arrow_schema, slices, text_bytes
from twinweave.llm.components import components
from twinweave.llm.shingles import DEFAULT, Measure, fingerprints, linked, sets_of, signatures
from twinweave.operators.checkpoints import discard, materialise

#: Cells of sketches: of all sets, of those that meet in buckets, and of those that are verified.
CELLS, MEET_CELLS, FINE_CELLS = 256, 512, 1024
_UNIT = "array<struct<x:int,y:int,asks:boolean>>"
BLOCK = 2048
#: Bitmaps of marked ids: bits for each id, and the least and the largest size.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def sketches(value: np.ndarray, at: np.ndarray, cells: int = CELLS, kind: type = np.uint8) -> np.ndarray:
    """Counts of each set's hashes over equal ranges, as many as the kind of number holds, as rows."""
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    cell = (value >> np.uint64(65 - cells.bit_length())).astype(np.int64)
    counts = np.bincount(rows * cells + cell, minlength=(len(at) - 1) * cells)
    return np.minimum(counts, np.iinfo(kind).max).astype(kind).reshape(-1, cells)


def profile(documents: DataFrame, measure: Measure = DEFAULT) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sketch) of every text."""
    ddl = "doc_id long,n_shingles long,f1 long,f2 long,sketch binary"

    def run(batches):
        schema = arrow_schema(ddl)
        for batch in batches:
            for part in slices(batch):
                value, at = sets_of(*text_bytes(part.column(1)), measure.width)
                f1, f2 = fingerprints(value, at)
                sketch = sketches(value, at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([s.tobytes() for s in sketch], pa.binary())], schema=schema)

    return _texts(documents).mapInArrow(run, ddl)


def signature_rows(documents: DataFrame, measure: Measure = DEFAULT) -> DataFrame:
    """(sig, doc_id) of the sets of all texts; of equal sets in a task, of the first alone."""
    ddl = "sig long,doc_id long"

    def run(batches):
        schema = arrow_schema(ddl)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch):
                value, at = sets_of(*text_bytes(part.column(1)), measure.width)
                f1, f2 = fingerprints(value, at)
                fresh = np.zeros(part.num_rows, bool)
                for i, key in enumerate(zip(f1.tolist(), f2.tolist(), strict=True)):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                row, sig = signatures(value, at, measure)
                kept = fresh[row]
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(sig[kept].view(np.int64)), pa.array(ids[row[kept]].astype(np.int64))], schema=schema)

    return _texts(documents).where("doc_id is not null").mapInArrow(run, ddl)


def _sketch_filter(pairs: DataFrame, profiles: DataFrame, measure: Measure, cells: int = CELLS, kind: type = np.uint8) -> DataFrame:
    """Those of the pairs (a, b) whose sketches, (node, n, sketch), allow a link."""
    side = lambda k: profiles.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                a, b, na, nb, sa, sb = part.columns
                x, y = (np.frombuffer(b"".join(s.to_pylist()), kind).reshape(-1, cells).astype(np.int32) for s in (sa, sb))
                near = measure.may_link(na.to_numpy(), nb.to_numpy(), np.abs(x - y).sum(axis=1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(near))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return joined.mapInArrow(run, "a long,b long")


def _bits(ids: DataFrame) -> tuple[np.ndarray, int]:
    """(bitmap of the long column node, its number of bits): sized by the number of rows, up to a bound (16 MB)."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("node"), F.lit(size))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return table, size


def _sets_for(documents: DataFrame, nodes: DataFrame, measure: Measure, cells: int = FINE_CELLS, kind: type = np.uint16) -> DataFrame:
    """(node, n, sketch, set) of the documents among ``nodes``: size, a finer sketch, and hashes as bytes."""
    spark = documents.sparkSession
    table, size = _bits(nodes)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    bitmap = spark.sparkContext.broadcast(table)
    ddl = "doc_id long,n long,sketch binary,set binary"

    def run(batches):
        schema = arrow_schema(ddl)
        for batch in batches:
            p = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (bitmap.value[p >> 6] >> (p & 63)) & 1
            for part in slices(batch.filter(pa.array(hit.astype(bool)))):
                value, at = sets_of(*text_bytes(part.column(1)), measure.width)
                fine = [x.tobytes() for x in sketches(value, at, cells, kind)]
                sets = [value[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(fine, pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    sets = _texts(documents).where("doc_id is not null").withColumn("p", place).mapInArrow(run, ddl)
    return sets.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "node")


def _verify(pairs: DataFrame, documents: DataFrame, measure: Measure) -> DataFrame:
    """The linked ones of the pairs (a, b), a written table: finer sketches first, then exact intersection of the sets.

    A pair's row carries a sketch of 2 KB through a shuffle; only pairs that these let pass carry a whole set.
    """
    nodes = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    sets = materialise(_sets_for(documents, nodes, measure), "sets")

    near = materialise(_sketch_filter(pairs, sets.select("node", "n", "sketch"), measure, FINE_CELLS, np.uint16), "near")

    def run(batches):
        for batch in batches:
            a, b, x, y = batch.columns
            keep = []
            for i in range(len(a)):
                left, right = np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64)
                keep.append(linked(len(left), len(right), len(np.intersect1d(left, right, assume_unique=True)), measure))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    out = materialise(joined.select("a", "b", "x", "y").mapInArrow(run, "a long,b long"), "links")
    discard(sets, nodes, near)
    return out


def _unsettled(members: DataFrame) -> DataFrame:
    """(node) of buckets that hold several components."""
    several = members.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
    return members.join(several, "sig", "left_semi").select("node").distinct()


def _across(members: DataFrame, profiles: DataFrame, measure: Measure) -> DataFrame:
    """Pairs (a, b) of different components in a bucket whose finer sketches, (node, n, sketch), allow a link.

    Sketches are compared where the members meet, first by sums of neighbouring cells, so that pairs that are near but
    not linked do not leave the task unless the finest bound lets them.

    ``members`` is (sig, node, component). In a bucket all but the largest component's members (the few) meet
    everyone. Both are cut into blocks of about BLOCK by a hash of the node, and each pair of a block of the few
    and a block of all is a unit of its own, so a task holds no more than two blocks at a time.
    """
    parts = members.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("n"))
    bucket = parts.groupBy("sig").agg(F.sum("n").alias("m"), (F.sum("n") - F.max("n")).alias("f"), F.max_by("component", F.struct("n", "component")).alias("most")).where("f > 0")
    rows = members.join(bucket, "sig").withColumn("few", F.col("component") != F.col("most"))
    # buckets of equal members are looked at once
    alike = rows.groupBy("sig").agg(F.bit_xor(F.xxhash64("node")).alias("h"), F.first("m").alias("m")).groupBy("h", "m").agg(F.min("sig").alias("sig"))
    rows = rows.join(alike.select("sig"), "sig", "left_semi")
    deal = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    rows = rows.withColumn("m", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("f", F.ceil(F.col("f") / BLOCK).cast("int"))
    rows = rows.withColumn("home", deal("m")).withColumn("own", deal("f"))
    asks = F.when(F.col("few"), F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.col("own").alias("x"), j.alias("y"), F.lit(True).alias("asks"))))
    stands = F.transform(F.sequence(F.lit(0), F.col("f") - 1), lambda i: F.struct(i.alias("x"), F.col("home").alias("y"), F.lit(False).alias("asks")))
    rows = rows.select("sig", "node", "component", "few", F.explode(F.concat(F.coalesce(asks, F.array().cast(_UNIT)), stands)).alias("u"))
    held = rows.join(profiles.select("node", "n", "sketch"), "node")
    held = held.select("sig", "u.x", "u.y", "node", "component", "few", "u.asks", "n", "sketch")
    keyed = held.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")

    def pairs_of(group: list) -> pa.RecordBatch | None:
        node, component, few, asks, size, sketch = (np.concatenate([g[i] for g in group]) for i in range(6))
        out_a, out_b = [], []
        standing = np.flatnonzero(~asks)
        s = sketch.astype(np.int32)
        coarse = s.reshape(len(s), CELLS, -1).sum(axis=2)
        for i in np.flatnonzero(asks):
            near = standing[component[standing] != component[i]]
            # of two of the few the one with the smaller id asks
            near = near[~few[near] | (node[near] > node[i])]
            if len(near):
                hit = near[measure.may_link(size[near], size[i], np.abs(coarse[near] - coarse[i]).sum(axis=1, dtype=np.int64))]
                hit = hit[measure.may_link(size[hit], size[i], np.abs(s[hit] - s[i]).sum(axis=1, dtype=np.int64))]
                out_a.append(np.full(len(hit), node[i]))
                out_b.append(node[hit])
        if not out_a:
            return None
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        waiting: list = []
        last = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:8]]
            sketch = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint8).reshape(-1, MEET_CELLS)
            n = batch.num_rows
            if not n:
                continue
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            for lo, hi in zip([0, *change], [*change, n], strict=True):
                key = (cols[0][lo], cols[1][lo], cols[2][lo])
                if key != last and waiting:
                    if (made := pairs_of(waiting)) is not None:
                        yield made
                    waiting = []
                last = key
                waiting.append((cols[3][lo:hi], cols[4][lo:hi], cols[5][lo:hi].astype(bool), cols[6][lo:hi].astype(bool), cols[7][lo:hi], sketch[lo:hi]))
        if waiting and (made := pairs_of(waiting)) is not None:
            yield made

    return keyed.mapInArrow(run, "a long,b long").distinct()


def join(documents: DataFrame, measure: Measure = DEFAULT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    made = materialise(profile(documents, measure), "profile")
    classes = made.where("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"))
    classes = materialise(classes.where("node is not null").withColumnRenamed("n_shingles", "n"), "classes")
    node_of = materialise(made.where("doc_id is not null and n_shingles > 0").join(classes.select(F.col("n").alias("n_shingles"), "f1", "f2", "node"), ["n_shingles", "f1", "f2"]).select("doc_id", "node").distinct(), "nodes")

    # rows that share an id but not a set are one document: edges between their classes
    several = node_of.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most")
    same_id = node_of.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    profiles = classes.select("node", "n", "sketch")

    shared = signature_rows(documents, measure).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("sig"))).where("k > 1").select("sig", "doc_id")
    members = shared.join(node_of, "doc_id").select("sig", "node").repartition("sig").dropDuplicates(["sig", "node"])
    members = members.withColumn("low", F.min("node").over(Window.partitionBy("sig"))).withColumn("high", F.max("node").over(Window.partitionBy("sig"))).where("low < high").select("sig", "node", "low")
    members = materialise(members, "members")

    star = members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    star = materialise(_sketch_filter(star, profiles, measure), "star")
    links = _verify(star, documents, measure)
    discard(star)
    first = components(links.union(same_id))
    placed = members.select("sig", "node").join(first, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
    nodes = materialise(_unsettled(placed), "nodes")
    fine = materialise(_sets_for(documents, nodes, measure, MEET_CELLS, np.uint8).drop("set"), "fine")
    across = materialise(_across(placed, fine, measure), "across")
    discard(members, first, nodes, fine)
    more = _verify(across, documents, measure)
    reached = components(links.union(more).union(same_id))
    discard(across, links, more, node_of)

    final = classes.select(F.col("n").alias("n_shingles"), "f1", "f2", "node").join(reached, "node", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "node").alias("component_id"))
    out = made.select("doc_id", "n_shingles", "f1", "f2").join(final, ["n_shingles", "f1", "f2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, measure: Measure = DEFAULT) -> DataFrame:
    """One document of each group, that with the smallest id; documents without a set and rows without an id stay.

    Rows of one id are one document. Ids to drop and ids of several rows are marked in a bitmap of bounded size;
    only documents that hit it are shuffled for the exact test. Columns of any name and type stay as they are.
    """
    joined = materialise(join(documents, measure), "joined")
    kept = joined.where("n_shingles = 0 or component_id = doc_id").select("doc_id").distinct()
    unsure = joined.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("n_shingles") > 0).alias("s"), F.min("component_id").alias("c")).where("k > 1 or (s and c <> doc_id)")
    unsure = materialise(unsure.select(F.col("doc_id").alias("node")), "unsure")
    table, size = _bits(unsure)
    filled = documents.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def marked(places: pd.Series) -> pd.Series:
        p = places.to_numpy(dtype=np.int64)
        return pd.Series((filled.value[p >> 6] >> (p & 63) & 1).astype(bool))

    # a null id stands at place 0 and is then let through by the test on ids
    hit = marked(F.coalesce(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(size)), F.lit(0).cast("long")))
    raised = documents.select(F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("k"), (hit & F.col("doc_id").isNotNull()).alias("hit"))
    sure = raised.where("not hit").select("d.*")
    tested = raised.where("hit").join(kept.withColumnRenamed("doc_id", "k"), "k", "left_semi").dropDuplicates(["k"])
    return sure.unionByName(tested.select("d.*"))
