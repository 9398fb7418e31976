"""The suffix tree's score against a plain restatement over words."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import ODD_TEXTS, documents, lower_words
from twinweave.llm import suffix_tree


def held_out(i):
    return zlib.crc32(str(i).encode()) % suffix_tree.FOLDS == suffix_tree.HELD_OUT


def plain_scores(texts):
    """Score of each text by the tree's definition, with dictionaries of word tuples."""
    tokens = [[*lower_words(t), ""] for t in texts]  # the empty word is the end
    counts = Counter()
    for i, ws in enumerate(tokens):
        if not held_out(i):
            for n in range(1, suffix_tree.DEPTH + 2):
                counts.update(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    kinds = sum(len(g) == 1 for g in counts)
    root = lambda w: (counts[(w,)] + 1) / (total + kinds + 1)
    p = {g: root(g[0]) for g, c in counts.items() if len(g) == 1 and c >= suffix_tree.LEAST}
    weights, stored_of = {}, {}
    for d in range(1, suffix_tree.DEPTH + 1):
        by_context = defaultdict(list)
        for g, c in counts.items():
            if len(g) == d + 1 and c >= suffix_tree.LEAST:
                by_context[g[:-1]].append((g, c))
        for context, rows in by_context.items():
            stored, types, size = sum(c for _, c in rows), len(rows), counts[context]
            weight = stored / (size + types)
            own = {g: weight * c / stored + (1 - weight) * p[g[1:]] for g, c in rows}
            gain = 2 * sum(c * math.log(own[g] / p[g[1:]]) for g, c in rows) + 2 * (size - stored) * math.log1p(-weight)
            retained = gain > types + 3 * math.sqrt(2 * types)
            if retained:
                weights[context], stored_of[context] = weight, stored
            for g, _ in rows:
                p[g] = own[g] if retained else p[g[1:]]

    def probability(history, word):
        out = root(word)
        for d in range(1, min(len(history), suffix_tree.DEPTH) + 1):
            context = tuple(history[-d:])
            if context in weights:
                c = counts[(*context, word)]
                out = weights[context] * (c if c >= suffix_tree.LEAST else 0) / stored_of[context] + (1 - weights[context]) * out
        return out

    return [sum(math.log10(probability(ws[:k], w)) for k, w in enumerate(ws)) for ws in tokens], len(weights)


@pytest.mark.parametrize("frequent", [suffix_tree.FREQUENT, 0.01])
def test_score_equals_the_definition(spark, monkeypatch, frequent):
    """Whether grams are broadcast or joined changes nothing."""
    monkeypatch.setattr(suffix_tree, "FREQUENT", frequent)
    rng = random.Random(12)
    phrases = ["to be or not to be", "the end of the day", "as it were", "once upon a time there was a king", "and so on", "x"]
    texts = [" ".join(rng.choice(phrases) for _ in range(rng.randrange(0, 12))) for _ in range(150)] + [*ODD_TEXTS[:-1], "once upon a time there was a queen", "to be or not to bee"] * 2
    want, retained = plain_scores(texts)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(documents(spark, texts, extra=["score", "h", "own"])).collect()}
    assert retained > 20
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-5)


def test_pieces_of_distinct_keys_sum_up():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        key = rng.integers(0, 1 << 63, max(n // 3, 1), dtype=np.uint64)[rng.integers(0, max(n // 3, 1), n)]
        at, count = suffix_tree.distinct(key)
        sums = Counter()
        for k, c in zip(key[at].tolist(), count.tolist(), strict=True):
            sums[k] += c
        assert sums == Counter(key.tolist())


def test_places_are_those_of_find():
    """Spread keys, keys in a narrow range, keys of one slot, and none."""
    import numpy as np

    rng = np.random.default_rng(3)
    spread = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    lumped = np.concatenate([np.arange(3000, dtype=np.uint64), np.array([0, 1 << 63, (1 << 64) - 1], np.uint64)])
    for keys in (spread, spread >> np.uint64(40), lumped, spread[:1], spread[:0]):
        keys = np.unique(keys)
        wanted = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 1 << 64, 3000, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        assert (suffix_tree.Places(keys).of(wanted) == suffix_tree.find(keys, wanted)).all()


def test_bitmaps_hold_their_keys(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    keys = rng.integers(-(1 << 63), 1 << 63, 20000)
    frame = spark.createDataFrame([(int(k),) for k in keys], "h long")
    table = suffix_tree.bitmap_of(frame, len(keys))
    assert suffix_tree.in_bitmap(table, keys.view(np.uint64)).all()
    assert suffix_tree.in_bitmap(table, rng.integers(0, 1 << 64, 20000, dtype=np.uint64)).mean() < 0.15
    assert not suffix_tree.bitmap_of(frame.limit(0), 0).any()


def test_documents_are_scored_by_shares(spark, monkeypatch):
    """Each round asks for its own documents alone, and what it wrote for that is gone when the next begins."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["a", "b", "c", "d e f", "g"]) for _ in range(rng.randrange(0, 30))) for _ in range(120)]
    want, _ = plain_scores([*texts, ""])
    frame, sizes = documents(spark, [*texts, None]), []

    def seen(df, name, made=suffix_tree.materialise):
        out = made(df, name)
        if name == "scores":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(suffix_tree, "materialise", seen)
    monkeypatch.setattr(suffix_tree, "FREQUENT", 0.01)
    rows = suffix_tree.score(frame.withColumn("doc_id", frame["doc_id"].cast("int"))).collect()
    assert len(sizes) == suffix_tree.ROUNDS and sum(sizes) == len(texts) + 1 and max(sizes) < 0.6 * len(texts)
    got = {r["doc_id"]: r["score"] for r in rows}
    assert [got[i] for i in range(len(texts) + 1)] == pytest.approx(want, abs=1e-5)


def test_additions_and_counts_come_packed(spark, monkeypatch):
    """One pass packs all additions, frequent ones in buckets of their own; counts bring the bits of their keys for the next depth's bitmap."""
    import numpy as np

    rng = random.Random(14)
    texts = [" ".join(rng.choice(["a", "b", "c", "d e f", "g", f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(0, 30))) for _ in range(150)]
    monkeypatch.setattr(suffix_tree, "FREQUENT", 0.01)
    frame = documents(spark, texts)
    model = suffix_tree.learn(frame)
    words = {r["h"] & (1 << 64) - 1: r["c"] for r in model.table.collect()}
    grams = sum(level.where("v is not null").count() + level.where("lead").count() for level in model.levels)
    got, entries = {}, 0
    for b, blob in suffix_tree.additions(model).collect():
        n = len(blob) // 19
        low, count = np.frombuffer(blob, suffix_tree._LOW, n), np.frombuffer(blob, np.int64, n, 11 * n)
        keys = suffix_tree._whole(low, (b & (1 << model.bits) - 1) >> model.bits - 8)
        got |= {k: (c, b >> model.bits) for k, c in zip(keys.tolist(), count.tolist(), strict=True) if c}
        entries += n
    assert entries == len(words) + grams
    assert got == {h: (c, int(c >= 0.01 * model.total)) for h, c in words.items()}
    assert {often for _, often in got.values()} == {0, 1}

    def pairs(text):
        value, row = suffix_tree.tokens(text)
        at = np.flatnonzero(row[1:] == row[:-1])
        return value[at], value[at + 1]

    rows = suffix_tree._counts(frame, pairs, ("first", "last"), 9, 2, ends=True).localCheckpoint()
    own = rows.where("n is not null").toArrow()
    keys = suffix_tree.combine(*(own.column(c).to_numpy().view(np.uint64) for c in ("first", "last")))
    table = suffix_tree.bitmap_of_blobs(rows.where("n is null").select("b", "high"), len(keys), 9, lambda blob, _: np.frombuffer(blob, np.uint32))
    assert len(keys) > 50 and (table == suffix_tree.bitmap_of(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "h long"), len(keys))).all()
    assert suffix_tree.in_bitmap(table, keys).all()


def test_short_hashes_depend_on_the_bytes_alone():
    """Spans of every length around eight bytes and the bound, at any place, with zero bytes, at the end of the data too."""
    import numpy as np

    from twinweave.llm.common import SHORT, short_hashes

    rng = random.Random(15)
    spans = [bytes(rng.choice(b"\x00ab") for _ in range(n)) for n in [*range(20), SHORT - 1, SHORT, SHORT + 1, 300] for _ in range(40)]
    spans += [b"\x00" * n for n in range(SHORT + 2)]
    seen = {}
    for _ in range(3):
        rng.shuffle(spans)
        data = np.frombuffer(b"x".join(spans), np.uint8)
        start = np.cumsum([0, *(len(s) + 1 for s in spans[:-1])])
        for span, h in zip(spans, short_hashes(data, start, start + [len(s) for s in spans]).tolist(), strict=True):
            assert seen.setdefault(span, h) == h
    assert len(set(seen.values())) == len(seen) == len(set(spans))
