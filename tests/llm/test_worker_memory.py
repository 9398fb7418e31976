"""What Python workers hold at once: slices of texts and Arrow batches are small."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from twinweave.llm import text_stats
from twinweave.llm.common import arrow_schema, lower_ascii, slices, text_bytes, word_bounds
from twinweave.llm.shingles import fingerprints, sets_of
from twinweave.operators.checkpoints import materialise


def test_arrays_of_a_step_stay_small():
    """Steps of the pipeline's stages on 6 MB of texts take less than 50 MB of arrays (95 in slices of 2 MB), and lose no row."""
    texts = [" ".join(f"w{i * j % 977}" for j in range(400)) for i in range(3500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert batch.nbytes > 6_000_000
    seen = 0
    tracemalloc.start()
    for part in slices(batch):
        value, at = sets_of(*text_bytes(part.column(0)), 5)
        fingerprints(value, at)
        seen += int(text_stats.count(*text_bytes(part.column(0)))["n_words"].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 400 * len(texts)
    assert peak < 50e6


def test_workers_get_small_batches(spark):
    """Tables are written with batches of about 4 MB (16 before), whatever their rows."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], schema=arrow_schema("n long,size long"))

    rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    got = materialise(rows.mapInArrow(sizes, "n long,size long"), "sizes").agg(F.sum("n"), F.max("size")).first()
    assert got[0] == 300
    assert got[1] < 6_000_000


def test_bytes_are_lowered_and_split_as_before():
    """A to Z alone are lowered; the bytes 9 to 13 and 32 alone part words, at any place and at rows' edges."""
    import numpy as np

    every = np.arange(256, dtype=np.uint8)
    assert lower_ascii(every).tobytes() == bytes(range(256)).lower()
    start, end, first = word_bounds(every, np.array([0, 20, 256]))
    assert start.tolist() == [0, 14, 20, 33] and end.tolist() == [9, 20, 32, 256] and first.tolist() == [0, 2, 4]


def test_additions_read_each_level_once_and_hashes_have_no_dictionary(spark):
    import glob

    import pyarrow.parquet as pq

    from twinweave.llm import suffix_tree

    docs = spark.createDataFrame([(i, " ".join("abcdefg"[i * j % 7] for j in range(20))) for i in range(40)], "doc_id long,text string")
    model = suffix_tree.learn(docs)
    plan = suffix_tree.additions(model)._jdf.queryExecution().optimizedPlan().toString()
    assert model.levels and plan.count("Relation [") == len(model.levels) + 1
    file = next(f for f in glob.glob(model.levels[0].written_to.removeprefix("file:") + "/part-*.parquet") if pq.ParquetFile(f).metadata.num_rows)
    group = pq.ParquetFile(file).metadata.row_group(0)
    found = {group.column(i).path_in_schema: group.column(i).has_dictionary_page for i in range(group.num_columns)}
    assert not found["h"] and found["n"]
