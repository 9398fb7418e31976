"""Hard negatives: bit-sliced products against plain ones, the whole operator against a restatement, odd rows."""

import math

import numpy as np
import pytest

from twinweave.llm import hard_negatives as hn
from twinweave.llm.hard_negatives import Rule, leaders, mine, survivors

DDL = "vec_id long, embedding array<float>, label int, id long, score long, extra string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, x, 1, 2, "z") for i, v, x in rows], DDL)


def restated(rows, rule):
    """(anchor, positive, rank, negative, positive score, negative score) by plain loops."""
    ok = [(i, x, [math.floor(rule.scale * float(np.float32(c))) for c in v]) for i, v, x in rows if i is not None and v is not None and x is not None and all(c is not None and math.isfinite(c) for c in v)]
    anchors = {}
    for i, x, v in sorted((r for r in ok if r[0] % rule.anchor_every == 0), key=lambda r: (r[0], r[1], r[2])):
        anchors.setdefault(i, (x, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(-sum(p * q for p, q in zip(v, w, strict=False)), i, x) for i, x, w in ok if i != a]
        positives = sorted((s, i) for s, i, x in scored if x == label)[: rule.positives]
        for s, i in positives:
            hard = sorted((t, j) for t, j, x in scored if x != label and rule.low * -s <= 100 * -t <= rule.high * -s)[: rule.negatives]
            out += [(a, i, n + 1, j, -s, -t) for n, (t, j) in enumerate(hard)]
    return sorted(out)


def got(frame):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in frame.collect())


@pytest.mark.parametrize("width", [3, 200, 30_000, 4_000_000])
def test_survivors_equal_plain_products(width):
    rng = np.random.default_rng(width)
    for best in (0, 1, 4):
        a, r = rng.integers(-width, width, (20, 9)).astype(np.int32), rng.integers(-width, width // 2 + 1, (70, 12)).astype(np.int32)
        scores = a.astype(np.int64) @ r[:, :9].astype(np.int64).T
        low, high = np.sort(rng.choice(scores.ravel(), (2, 20)), axis=0)
        allowed = rng.random((20, 70)) < 0.7
        fits = allowed & (scores >= low[:, None]) & (scores <= high[:, None])
        i, j, s = survivors(a, r, low, high, allowed.copy(), best)
        assert (s == scores[i, j]).all() and fits[i, j].all()
        made = np.zeros_like(fits)
        made[i, j] = True
        if not best:
            assert (made == fits).all()
        for k in range(20):  # the best of all that qualify are among what is left
            want = np.sort(scores[k][fits[k]])[::-1][:best]
            assert (np.sort(scores[k][made[k]])[::-1][: len(want)] == want).all()


def test_few_candidates_are_dropped_plane_by_plane(monkeypatch):
    rng = np.random.default_rng(1)
    a, r = rng.integers(-99, 99, (10, 8)).astype(np.int32), rng.integers(-99, 99, (400, 8)).astype(np.int32)
    scores = a.astype(np.int64) @ r.astype(np.int64).T
    low = np.sort(scores, axis=1)[:, -3]
    for few in (0.0, 1 / 16, 2.0):
        monkeypatch.setattr(hn, "FEW", few)
        i, j, s = survivors(a, r, low, np.full(10, 1 << 40))
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(scores >= low[:, None])), strict=True))


def test_leaders():
    key, score, ids = np.array([1, 0, 1, 1, 0]), np.array([5, 2, 5, 9, 2]), np.array([8, 4, 3, 7, 1])
    assert leaders((key,), score, ids, 2).tolist() == [4, 1, 3, 2]


def test_operator_equals_restatement(spark, monkeypatch):
    rng = np.random.default_rng(4)
    # few distinct values: many ties, at window ends too
    rows = [(int(i), [float(x) for x in rng.integers(-3, 5, 5) / 8], int(rng.integers(0, 3))) for i in range(400)]
    rows += [(7, [0.5] * 5, 1), (7, [0.5] * 5, 1), (10, [0.25] * 5, 2), (10, [0.25] * 5, 1)]  # repeated rows and ids, an anchor's too
    odd = [(None, [0.5] * 5, 1), (500, None, 1), (501, [0.5, None, 1.0, 0.1, 0.1], 1), (510, [float("nan")] + [0.1] * 4, 1), (503, [float("inf")] + [0.0] * 4, 2), (520, [0.4] * 5, None), (530, [], 0), (531, [], 1), (540, [0.5, 0.5], 1), (541, [0.5] * 9, 1)]
    rule = Rule(anchor_every=10)
    want = restated(rows + odd, rule)
    frame = table(spark, rows + odd)
    assert got(mine(frame, rule)) == want
    monkeypatch.setattr(hn, "ANCHOR_BYTES", 1500)  # several groups of anchors
    monkeypatch.setattr(hn, "SHARE_ROWS", 100)
    assert got(mine(frame.repartition(3), rule)) == want


def test_doubles_other_names_and_few_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, [-1.0, 0.0], 2)], "k long, v array<double>, lab long")
    out = mine(rows, Rule(), "k", "v", "lab").collect()
    assert [(r["anchor_id"], r["positive_id"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in out] == [(0, 1, 2, 256 * 256 + 128 * 128, 256 * 128 + 128 * 128)]
    assert mine(rows.where("k <> 1"), Rule(), "k", "v", "lab").count() == 0
    assert mine(rows.limit(0), Rule(), "k", "v", "lab").count() == 0


def test_components_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="might not fit"):
        mine(table(spark, [(0, [1e9], 1), (1, [1.0], 1)])).count()
