"""Mixing sources to target weights by weighted fair queueing (operator 4).

Every document of a source waits in a queue whose order is a shuffle by hash; a queue may be served ``repeats``
times over. Documents are served in packets of at most QUANTUM words. A packet's virtual finish time is the words of
its source up to and with it, divided by the source's target. All packets are range-sorted by virtual finish time
and written; the mix is the beginning of this stream, up to the packet with which the running total of words
reaches the budget, which is cut there. Running totals come from one sum for each range and, in the range where
the budget ends, from its rows. As sources are served side by side, each ends within a packet or two of its target.

Targets: weights repeat over the sources in code point order (null last); no target exceeds ``repeats``
times its source's size, and what that leaves over is shared again by weight. The budget is the sum of all targets
unless a smaller one is given; packets that begin beyond virtual time 1 are not made, as the budget is spent by then.

Plan: one scan for sizes, written to the shared folder; prefix sums in two steps (hash ranges of a source,
then rows within a range), so that a source with a third of all rows is spread over BUCKETS tasks' worth of
ranges. Only one row for each source, one for each source and range, and one for each range of the stream meet in a
wider window.

Defined results: null and empty texts have size 0 and take 0; a null source is a source of its own, last in
order; a source without words has target 0; equal rows share the same place in order, one after another; further
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.common import WORD
from twinweave.operators.checkpoints import discard, materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BUCKETS = 4096
SEED = "mix1"
#: Words of a packet.
QUANTUM = 64


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_col: str = "doc_id", seed: str = SEED) -> Column:
    """A 60-bit number from a hash of the id: the place in the source's queue."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, weight, target) by source."""
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", (F.col("source_size") * repeats).cast("double")).withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
    # filling by weight, the sources that reach their cap first are full before the others
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    full = by_level.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return per.select("source", "source_size", "weight", target.alias("target")).withColumn("all_targets", F.sum("target").over(whole))


def plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document, with a row number, its source's size and target, and where its source's queue has it (``start``, in words)."""
    sizes = documents.select("doc_id", *keep, F.col("source"), word_count().alias("size"), shuffle_key(seed=seed).alias("key"), F.monotonically_increasing_id().alias("row_id"))
    sizes = materialise(sizes, "mix-sizes").withColumn("bucket", F.shiftright("key", 60 - BUCKETS.bit_length() + 1))
    targets = source_targets(sizes, weights, share, repeats)
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(by_bucket), F.lit(0)))
    ranges = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.source", "bucket", "before", "source_size", "target", "all_targets")
    rows = sizes.alias("s").join(ranges.alias("r"), F.col("s.source").eqNullSafe(F.col("r.source")) & (F.col("s.bucket") == F.col("r.bucket")))
    within = Window.partitionBy("s.source", "s.bucket").orderBy("key", "doc_id", *[f"s.{c}" for c in keep], "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return rows.select("row_id", "doc_id", "key", *[f"s.{c}" for c in keep], "s.source", "size", "source_size", "target", "all_targets", start.alias("start"))


def packets(planned: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """A row for each packet of each document and round, with its words and its virtual finish time."""
    rounds = planned.where("target > 0 and size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rounds = rounds.withColumn("begun", F.col("source_size") * F.col("round") + F.col("start")).where("begun < target")
    last = F.least(F.col("size") - 1, F.ceil(F.col("target") - F.col("begun")) - 1)
    rounds = rounds.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / QUANTUM))))
    done = F.least(F.col("size"), (F.col("packet") + 1) * QUANTUM)
    return rounds.withColumn("words", done - F.col("packet") * QUANTUM).withColumn("finish", (F.col("begun") + done) / F.col("target"))


def served(planned: DataFrame, repeats: int = REPEATS, budget: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, *keep, source, round, finish, all_targets, place, words) of the packets that are served, the last one cut where the budget ends."""
    order = ["finish", F.col("source").isNull(), "source", "round", "key", "doc_id", "size", "packet", "row_id"]
    sent = packets(planned, repeats).select("row_id", *keep, "round", "finish", "words", "all_targets", *[c for c in ("source", "key", "doc_id", "size", "packet") if c not in keep])
    spread = sent.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    columns = ["row_id", *keep, "source", "round", "finish", "all_targets", "place"]
    held = materialise(spread.withColumn("place", place).select(*columns, "words"), "mix-stream")
    part = F.shiftright("place", 33).alias("part")
    most = F.col("all_targets") if budget is None else F.least(F.col("all_targets"), F.lit(float(budget)))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = held.groupBy(part).agg(F.sum("words").alias("total"), F.floor(F.first(most) + 0.5).alias("budget"))
    ranges = ranges.select("part", "total", "budget", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before")).where("before < budget")
    rows = held.withColumn("part", part).join(F.broadcast(ranges), "part")  # one row for each range
    upto = F.sum("words").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    whole = rows.where("before + total <= budget").select(*columns, "words")
    at_end = rows.where("before + total > budget").withColumn("left", F.col("budget") - F.col("before") - F.coalesce(upto, F.lit(0)))
    return whole.unionByName(at_end.where("left > 0").select(*columns, F.least("words", "left").alias("words")))


def stream(planned: DataFrame, repeats: int = REPEATS, budget: float | None = None) -> DataFrame:
    """The packets that are served, in order of virtual finish time."""
    return served(planned, repeats, budget).orderBy("place")


def mix(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of every document, over all rounds."""
    planned = materialise(plan(documents, **options), "mix-plan")
    mixed = served(planned, options.get("repeats", REPEATS))
    taken = mixed.groupBy("row_id").agg(F.sum("words").alias("words"))
    return planned.join(taken, "row_id", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def mix_documents(documents: DataFrame) -> DataFrame:
    """Documents as the mix serves them: a row for each round of which a packet is served, the text whole; the columns stay.

    Rows are recognised by a 64-bit hash of all their columns; equal rows share out their rounds.
    """
    columns = documents.columns
    whole = documents.select(F.struct("*").alias("d"), F.xxhash64(*columns).alias("k"))
    sizes = whole.select("d.doc_id", "d.source", "d.text", "k")
    taken = served(plan(sizes, keep=("k",)), keep=("k",)).groupBy("k", "row_id", "round").agg(F.sum("words").alias("words"))
    rounds = taken.groupBy("k").agg(F.count(F.lit(1)).alias("rounds"))
    alike = Window.partitionBy("k")
    out = whole.join(rounds, "k").withColumn("place", F.row_number().over(alike.orderBy("k"))).withColumn("alike", F.count(F.lit(1)).over(alike))
    copies = F.floor((F.col("rounds") + F.col("alike") - F.col("place")) / F.col("alike")).cast("int")
    return out.withColumn("copies", copies).where("copies > 0").select("d", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("d.*")
