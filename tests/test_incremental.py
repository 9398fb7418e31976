"""Clusters kept up to date: equal to a full run after every addition, and only touched components are clustered again."""

import numpy as np
import pytest

from twinweave.operators import clustering, incremental, similarity
from tests.test_clustering import _items


def found(members):
    return {r["item_idx"]: (r["slot"], r["member_pos"], round(r["average_similarity"], 9)) for r in members.collect()}


def sample(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(14, 6))
    vectors = (base[rng.integers(0, 14, n)] + 0.22 * rng.normal(size=(n, 6))).astype(np.float32)
    vectors[rng.integers(0, n, n // 5)] = vectors[0] * 2  # copies, in all parts
    vectors[3] = 0
    return vectors, rng.integers(0, n // 3, n).tolist()


@pytest.mark.parametrize("constrained", [False, True])
def test_three_additions_equal_a_full_run(spark, constrained):
    vectors, sources = sample(90, 3)
    items = _items(spark, vectors.tolist(), sources)
    state = incremental.begin(items.where("item_idx % 3 = 0"), 0.85, constrained)
    assert state.clustered == 30
    for k, part in enumerate(("item_idx % 6 = 1", "item_idx % 6 = 4", "item_idx % 3 = 2")):
        state = incremental.extend(state, items.where(part))
        seen = state.items.select("item_idx")
        whole = clustering.clusters(items.join(seen, "item_idx", "left_semi"), 0.85, constrained)
        assert found(state.members) == found(whole), k
    again = incremental.extend(state, items.where("item_idx < 40"))  # all are there already
    assert again.clustered == 0 and found(again.members) == found(state.members)
    groups, members = state.groups()
    want, _ = clustering.analyse(items, 0.85, constrained)
    assert sorted(map(tuple, groups.drop("average_similarity").collect())) == sorted(map(tuple, want.drop("average_similarity").collect()))
    assert members.count() == 90


def test_untouched_groups_are_not_clustered_again(spark):
    rng = np.random.default_rng(4)
    base = np.eye(8)
    vectors = (np.repeat(base, 10, axis=0) + 0.05 * rng.normal(size=(80, 8))).tolist()
    state = incremental.begin(_items(spark, vectors), 0.9, False)
    more = _items(spark, [(base[0] + 0.02).tolist(), [0.0] * 7 + [-5.0]]).selectExpr("item_idx + 1000 as item_idx", "source_id", "features")
    after = incremental.extend(state, more)
    assert after.clustered == 12  # ten of the first group, the new one of it, and one that stands alone
    slots = found(after.members)
    assert slots[1000][0] == 0 and slots[1001][0] == 1001
    # one item that joins two groups touches both
    joint = _items(spark, [(base[1] + base[2]).tolist()]).selectExpr("item_idx + 2000 as item_idx", "source_id", "features")
    assert incremental.extend(incremental.begin(_items(spark, vectors), 0.7, False), joint).clustered == 21


def test_pairs_of_two_tables(spark):
    vectors, sources = sample(70, 5)
    items = _items(spark, vectors.tolist(), sources)
    for constrained in (False, True):
        both = similarity.pairs_native(items, 0.6, constrained).where("(i < 20) <> (j < 20)")
        got = similarity.cross_pairs(items.where("item_idx >= 20"), items.where("item_idx < 20"), 0.6, constrained, 16)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, both.collect()))
    assert similarity.cross_pairs(items.limit(0), items, 0.5).count() == 0


@pytest.mark.parametrize("constrained", [False, True])
def test_new_rows_of_a_large_table_go_through_the_index(spark, monkeypatch, constrained):
    """Beyond the grid, both tables go through one index, which makes no pair of two earlier rows; no table is sent once for each block of the other."""
    vectors, sources = sample(90, 7)
    vectors[5] = vectors[6] * np.float32(1e-20)  # angles say nothing sure about it
    vectors[8] = vectors[9] * np.float32(1e-20)
    items = _items(spark, vectors.tolist(), sources)
    monkeypatch.setattr(similarity, "GRID_ROWS", 10)
    monkeypatch.setattr(similarity, "cross_pairs", None)
    want = similarity.pairs_native(items, 0.6, constrained).where("i % 3 = 1 or j % 3 = 1")
    got = similarity.new_pairs(items.where("item_idx % 3 = 1"), items.where("item_idx % 3 <> 1"), 0.6, constrained)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_beginning_with_nothing(spark):
    items = _items(spark, [[1, 0], [1, 0.01], [0, 1]])
    state = incremental.extend(incremental.begin(items.limit(0), 0.9), items)
    assert found(state.members) == found(clustering.clusters(items, 0.9))
