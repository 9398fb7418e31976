"""The facade: progress, cancelling, and what a new result keeps."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinweave.config import Settings
from twinweave.plans.finder import DuplicateFinder


def items(spark, n=40):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(n // 2, 8))
    vectors = np.concatenate([base, base + 0.01 * rng.normal(size=base.shape)])
    return spark.createDataFrame([(i, str(i), v.tolist()) for i, v in enumerate(vectors)], "item_idx long, source_id string, features array<double>").withColumn("features", F.col("features").cast("array<float>"))


def test_progress_bands(spark):
    told = []
    finder = DuplicateFinder(spark, Settings(threshold=0.9), progress=lambda step, share: told.append((step, share)))
    head, found, members = finder.analyse(items(spark))
    marks = [("similarity", 0.0), ("clustering", 0.7), ("statistics", 0.95), ("done", 1.0)]
    assert [x for x in told if x in marks] == marks  # and what was measured between them
    assert head.first()["duplicate_groups"] == 20 and found.count() == 20 and members.count() == 40


def test_a_new_result_keeps_the_sort_and_drops_the_filter(spark):
    finder = DuplicateFinder(spark, Settings(threshold=0.9))
    found = finder.analyse(items(spark))[1]
    assert finder.view(found, "Exact", "Name").count() < 20
    names = [r["name"] for r in finder.view(found).orderBy("group_rank").collect()]
    assert len(names) == 20 and names == sorted(names)


def test_cancelling_ends_a_run(spark):
    @F.udf("array<float>")
    def slow(v):
        time.sleep(1)
        return v

    finder = DuplicateFinder(spark, Settings(threshold=0.9), tag="to-be-cancelled")
    ended = []

    def run():
        try:
            finder.analyse(items(spark, 400).repartition(1).withColumn("features", slow("features")))
        except Exception as e:
            ended.append(str(e))

    worker = threading.Thread(target=run)
    began = time.time()
    worker.start()
    while worker.is_alive() and time.time() - began < 90:
        time.sleep(2)
        finder.cancel()
    worker.join(5)
    assert ended and "cancel" in ended[0].lower()


def test_vectors_of_two_lengths(spark):
    rows = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [1.0, 0.0, 0.0])], "item_idx long, source_id string, features array<float>")
    with pytest.raises(ValueError, match="differ"):
        DuplicateFinder(spark).analyse(rows)


def test_settings_that_void_features(spark, tmp_path):
    from twinweave.operators.feature_store import FeatureStore

    finder, store, derived = DuplicateFinder(spark, Settings(threshold=0.9)), FeatureStore(spark, str(tmp_path / "store")), []
    files = spark.createDataFrame([(k, str(k), f"/{k}.png", k + 1, None) for k in range(6)], "item_idx long, source_id string, file_path string, file_size long, modified_at timestamp")

    def derive(fresh):
        derived.append(fresh.count())
        return fresh.withColumn("features", F.array(F.lit(1.0), (F.col("item_idx") % 2).cast("double")).cast("array<float>"))

    held = finder.refresh(store, files, derive)
    assert held.count() == 6 and finder.analyse(held)[0].first()["duplicate_groups"] == 2
    assert not finder.reconfigure(Settings(threshold=0.5)) and finder.refresh(store, files, derive).count() == 6
    assert derived == [6]
    assert finder.reconfigure(Settings(layout="NHWC")) and finder.refresh(store, files, derive).count() == 6
    assert derived == [6, 6]
    assert finder.use_bundled_model() and finder.settings.layout == "NCHW" and finder.settings.downsampling == "Bilinear"
