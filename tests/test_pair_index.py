"""The metric index: rows of the full grid, whatever the vectors; what it saves; its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinweave.operators import pair_index, similarity
from twinweave.operators.pair_index import RINGS, Report, dealt, indexed_pairs, partners, spread_out


def table(spark, vectors, sources=None):
    rows = [(i, str((sources or range(len(vectors)))[i]), list(map(float, v))) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "item_idx long, source_id string, features array<double>").withColumn("features", F.col("features").cast("array<float>"))


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def clustered(n, dims=16, centres=12, noise=0.25, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dims))
    return base[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dims))


@pytest.mark.parametrize("threshold", [0.0, 0.4, 0.75, 0.97])
@pytest.mark.parametrize("constrained", [False, True])
def test_rows_of_the_grid(spark, threshold, constrained):
    rng = np.random.default_rng(2)
    vectors = np.concatenate([clustered(160), rng.normal(size=(60, 16))])
    vectors[40:50] = vectors[0] * np.array([1, 2, 0.5, 4, 1, 1, 8, 2, 1, 1])[:, None]  # copies
    vectors[50], vectors[51], vectors[52], vectors[53] = 0, 1e-22, 3e20, vectors[1] * 1e-30  # odd ones
    vectors[54, 3], vectors[55, 0] = np.nan, np.inf
    items = table(spark, vectors, rng.integers(0, 40, len(vectors)).tolist())
    want = rows(similarity.similar_pairs(items, threshold, constrained))
    assert want == rows(similarity.pairs_native(items, threshold, constrained))
    for block_rows, pivots in ((20, 5), (64, 16), (1000, 1)):
        assert rows(indexed_pairs(items, threshold, constrained, len(vectors), block_rows, pivots)) == want


def test_ties_at_the_threshold(spark):
    """Vectors of small whole numbers: many pairs lie exactly at a threshold."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-1, 2, (240, 4))
    items = table(spark, vectors)
    for threshold in (0.5, 0.7071067811865475, 1.0):
        want = rows(similarity.similar_pairs(items, threshold, False))
        assert any(s == threshold for _, _, s in want) or threshold != 0.5
        assert rows(indexed_pairs(items, threshold, False, len(vectors), 16, 12)) == want


def test_share_of_pairs_on_clustered_vectors(spark):
    report = Report()
    items = table(spark, clustered(2000, dims=32, centres=20, noise=0.2, seed=5))
    want = rows(similarity.similar_pairs(items, 0.75, False))
    assert rows(indexed_pairs(items, 0.75, False, 2000, 100, 20, report)) == want
    assert report.pairs == 2000 * 1999 // 2 and len(want) > 50_000
    assert report.share < 0.5 and report.blocks > 20


def test_many_rows_take_the_index(spark, monkeypatch):
    monkeypatch.setattr(similarity, "GRID_ROWS", 100)
    items = table(spark, clustered(300, seed=7))
    assert rows(similarity.similar_pairs(items, 0.9, False)) == rows(similarity.pairs_native(items, 0.9, False))
    assert similarity.similar_pairs(items.limit(0), 0.9).count() == 0


def test_a_block_goes_to_its_partners_alone(spark):
    """Rows of the exchange are packed blocks: two for each unit, not a row for each vector and block."""
    items = table(spark, clustered(400, seed=8))
    report = Report()
    plan = indexed_pairs(items, 0.95, False, 400, 40, 12, report)._jdf.queryExecution().toString()
    assert "hashpartitioning(a" in plan and "features" not in plan


def test_parts():
    pivots = spread_out(np.array([[1, 0], [2, 0], [0, 3], [0, 0], [np.nan, 1], [-1, 0]]), 5)
    assert pivots.tolist() == [[1, 0], [-1, 0], [0, 1]]
    assert spread_out(np.zeros((3, 4)), 2).shape == (1, 4)
    assert dealt([(0, 1, 5), (0, 0, 5), (0, 2, 1), (1, 0, 25), (1, 1, 3)], 10) == [(0, 0, 0, 1), (0, 1, 0, 1), (0, 2, 1, 1), (1, 0, 2, 3), (1, 1, 3, 1)]
    low, high = np.array([[0.0], [0.3], [2.0]]), np.array([[0.2], [0.5], [2.1]])
    assert partners(low, high, float(np.cos(0.2))).tolist() == [[True, True, False], [True, True, False], [False, False, True]]
    away = pair_index.angles(np.array([[0, 0], [1, 1]], np.float32), np.array([[1.0, 0.0]]))
    assert away[:, 0] == pytest.approx([np.pi / 2, np.pi / 4]) and RINGS > 1


def test_a_block_is_sent_to_a_bounded_number_of_units(spark, monkeypatch):
    """However many blocks there are, the exchange holds each at most SPREAD times; rows stay those of the grid."""
    monkeypatch.setattr(pair_index, "SPREAD", 3)
    items = table(spark, np.random.default_rng(4).normal(size=(300, 16)))
    report = Report()
    found = indexed_pairs(items, 0.3, False, 300, 10, 4, report)
    assert report.blocks >= 30 and rows(found) == rows(similarity.similar_pairs(items, 0.3, False))
    stacks = pair_index.stacked([(k, 10) for k in range(3000)], 64, 16)
    assert max(stacks.values()) + 1 == 16 and sorted(stacks.values()) == list(stacks.values())
    assert max(pair_index.stacked([(k, 1 << 20) for k in range(8)], 256, 1).values()) == 7
