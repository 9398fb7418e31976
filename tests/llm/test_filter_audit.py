"""Filter audit: polynomials against plain application of filters in all orders, masks against plain rules, odd rows."""

import random
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest

from tests.llm.helpers import ODD_TEXTS, documents, words
from twinweave.llm import filter_audit as fa
from twinweave.llm.filter_audit import FILTERS, Removals, audit, audit_part, mask_counts

LABELS = "doc_id long, quality int, toxic int"


def applied(masks, order, step):
    """(kept, removed, redundant) after applying an order's filters one after another to documents of these masks."""
    left, gone = list(masks), []
    for k in range(step):
        bit = 1 << FILTERS.index(order[k])
        out = [m for m in left if m & bit]
        redundant = sum(1 for m in gone if m & bit)
        left = [m for m in left if not m & bit]
        gone += out
    return len(left), len(out), redundant


def test_polynomials_equal_plain_application():
    rng = random.Random(1)
    for size in (0, 1, 7, 60):
        masks = [rng.randrange(32) for _ in range(size)]
        good = [rng.random() < 0.4 for _ in masks]
        counts, valued = Counter(masks), Counter(m for m, g in zip(masks, good, strict=True) if g)
        rows = audit_part([counts[m] for m in range(32)], [valued[m] for m in range(32)], [0] * 32)
        assert len(rows) == 600 and len({r[:2] for r in rows}) == 600
        total = Counter()
        for order, step, kept, removed, redundant, alone, good_lost, toxic_lost, _ in rows:
            assert (kept, removed, redundant) == applied(masks, order, step)
            bit = 1 << FILTERS.index(order[step - 1])
            assert alone == counts[bit] and toxic_lost == 0
            before = sum(1 << FILTERS.index(c) for c in order[: step - 1])
            assert good_lost == sum(n for m, n in valued.items() if m & bit and not m & before)
            total[order[step - 1]] += removed
        assert all(r[-1] == total[r[0][r[1] - 1]] for r in rows)


def test_polynomial_between_corners():
    """At any point the polynomial is the expected number of removals, term by term."""
    rng = random.Random(2)
    counts = [rng.randrange(9) for _ in range(8)]
    f = Removals(counts, 3)
    x = [Fraction(rng.randrange(8), 7) for _ in range(3)]

    def product(mask, values):
        out = Fraction(1)
        for i in range(3):
            if mask >> i & 1:
                out *= values[i]
        return out

    assert sum(c * product(s, x) for s, c in enumerate(f.coefficients)) == sum(n * (1 - product(m, [1 - v for v in x])) for m, n in enumerate(counts))
    for i in range(3):
        orders = [o for o in permutations(range(3))]
        mean = Fraction(sum(f.corners[sum(1 << j for j in o[: o.index(i) + 1])] - f.corners[sum(1 << j for j in o[: o.index(i)])] for o in orders), len(orders))
        assert f.shapley(i) == mean


def restated(texts, ids, parts, labels):
    """{(part, mask): (n, good, toxic)} by plain rules."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    out: dict = {}
    for text, i, part in zip(texts, ids, parts, strict=True):
        text = text or ""
        w = words(text)
        fails = [
            len(w) < 50,
            100 * len(set(w)) < 65 * len(w),
            100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            any(c in "#$%&*|" for c in text),
            i is not None and any(j is not None and j < i and (t or "") == text for t, j in zip(texts, ids, strict=True)),
        ]
        key = (part or "", sum(f << k for k, f in enumerate(fails)))
        held = out.setdefault(key, [0, 0, 0])
        held[0] += 1
        held[1] += i in good and i is not None
        held[2] += i in toxic and i is not None
    return {k: tuple(v) for k, v in out.items()}


def counted(frame):
    return {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in frame.collect()}


def test_masks_of_odd_rows(spark):
    rng = random.Random(3)
    fill = [" ".join(rng.choice(["alpha", "Beta", "GAMMA", "d#", "é"]) + str(rng.randrange(k)) for _ in range(n)) for k in (2, 40, 900) for n in (1, 49, 50, 51, 300)]
    exact = [" ".join(["same"] * 35 + [f"w{i}" for i in range(64)] + ["same"]), " ".join(["same"] * 36 + [f"w{i}" for i in range(64)]), "A" * 5 + "b" * 95, "A" * 6 + "b" * 94]
    texts = [*ODD_TEXTS, *fill, *exact, *fill, "one", None, "", *fill[:4]]
    ids = [*rng.sample(range(1000), len(texts) - 8), 5, 5, None, None, 7, 7, 2000, -3]
    texts[-8:] = ["twice", "twice", "twice", "no id", "two texts of an id", "one", "twice", "no id"]
    parts = [rng.choice(["a", "b", "", None]) for _ in texts]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in ids[::2] if i is not None] + [(ids[0], 1, 0), (ids[0], 0, 1), (None, 1, 1), (99999, 1, 1), (5, None, None), (7, 1, None)]
    frame = spark.createDataFrame([(i, t, None, p, 3, 1) for i, t, p in zip(ids, texts, parts, strict=True)], "doc_id long, text string, lang string, source string, n long, good long").repartition(3)
    known = spark.createDataFrame(labels, LABELS)
    want = restated(texts, ids, parts, labels)
    assert counted(mask_counts(frame, known)) == want
    rows = audit(frame, known).collect()
    assert len(rows) == 600 * len({p for p, _ in want})
    for r in rows:
        masks = [m for (p, m), (n, _, _) in want.items() if p == r["part"] for _ in range(n)]
        assert (r["kept"], r["removed"], r["redundant"]) == applied(masks, r["filter_order"], r["step"])


def test_one_text_of_many_copies(spark):
    """A text under very many ids stays a few rows: one document of it is first, wherever it lies."""
    frame = spark.range(20000).selectExpr("id + 10 as doc_id", "'copied' as text", "cast(id % 3 as string) as source").unionByName(spark.createDataFrame([(4, "copied", "far")], "doc_id long, text string, source string"))
    got = counted(mask_counts(frame, spark.createDataFrame([(4, 1, 0), (11, 1, 1)], LABELS)))
    assert got[("far", 1)] == (1, 1, 0) and sum(n for n, _, _ in got.values()) == 20001
    assert {k for k in got if k[1] == 17} == {("0", 17), ("1", 17), ("2", 17)} and got[("1", 17)][1:] == (1, 1)


@pytest.mark.parametrize("labelled", [True, False])
def test_empty_tables(spark, labelled):
    none = spark.createDataFrame([], LABELS)
    frame = documents(spark, ["x"])
    assert audit(frame.limit(0), none if labelled else spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0
    rows = audit(frame, none).collect()
    assert len(rows) == 600 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in rows)


def test_limits_are_inclusive_where_stated():
    import numpy as np

    def bits(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return int(fa.failures(data, np.array([0, len(data)]))[0])

    assert bits(" ".join(["x"] * 35 + [f"w{i}" for i in range(64)])) & 2 == 0  # 65 distinct of 99
    assert bits(" ".join(["x"] * 36 + [f"w{i}" for i in range(64)])) & 2 == 0  # 65 of 100
    assert bits(" ".join(["x"] * 37 + [f"w{i}" for i in range(64)])) & 2 == 2
    assert bits("A" * 5 + "b" * 95) & 4 == 0 and bits("A" * 6 + "é" * 94) & 4 == 4
