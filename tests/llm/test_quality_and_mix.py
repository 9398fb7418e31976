"""Quality rules, quality classifier and the mix."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, ODD_TEXTS, WORD, documents, words
from tests.oracle import expected, rows
from twinweave.llm import mixing, quality_model, quality_rules, text_stats
from twinweave.llm.common import table
from twinweave.llm.oracles import ORACLE_SQL
from twinweave.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"


def plain_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_unique_words": len(set(w)), "n_adjacent": sum(a == b for a, b in zip(w, w[1:], strict=False)), "n_upper": sum("A" <= c <= "Z" for c in text), "n_lower": sum("a" <= c <= "z" for c in text),
        "n_digits": sum("0" <= c <= "9" for c in text), "n_pipes": text.count("|"), "n_bangs": text.count("!"), "n_ends": sum(x[-1] in ".," for x in w), "n_lines": len(lines),
    }


def test_counts(spark):
    docs = documents(spark, [*ODD_TEXTS, "a b c d e f a b c d e", "x\n\ny\n"], extra=["n_words", "stratum"])
    for r in text_stats.with_stats(docs.select("doc_id", "text"), ["doc_id"]).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert {c: r[c] for c in text_stats.COUNTS} == plain_counts(r["text"])
    for r in docs.withColumn("s", text_stats.stats_column()).collect():
        assert r["s"].asDict() == plain_counts(r["text"])


def test_exact_binomial_bounds():
    assert quality_rules.binomial_tail(0, 100, 0.03) == pytest.approx(0.97**100)
    assert quality_rules.binomial_tail(5, 5, 0.5) == 1.0
    # Clopper-Pearson for 0 of n is closed: 1 - delta ** (1 / n)
    assert quality_rules.upper_bound(0, 50, 0.05) == pytest.approx(1 - 0.05 ** (1 / 50))
    bound = quality_rules.upper_bound(3, 80, 0.05)
    assert quality_rules.binomial_tail(3, 80, bound) == pytest.approx(0.05)


def test_choice_stops_at_the_first_failure():
    n = len(quality_rules.CUTOFFS)
    assert quality_rules.choose([("en", 1000, [0] * n)]) == {"en": quality_rules.CUTOFFS[-1]}
    assert quality_rules.choose([("en", 1000, [0, 0, 0, 900, *[0] * (n - 4)])]) == {"en": quality_rules.CUTOFFS[2]}
    assert quality_rules.choose([("en", 20, [0] * n), (None, 0, [0] * n)]) == {}
    assert quality_rules.choose([]) == {}


def test_false_rejections_are_limited():
    """Over many draws of holdouts, a cutoff that rejects too much is chosen in fewer than DELTA of them."""
    rng = np.random.default_rng(4)
    n = len(quality_rules.CUTOFFS)
    bad = sum(quality_rules.choose([("x", 400, [int((rng.random(400) < 1.5 * quality_rules.ALPHA).sum())] * n)]) != {} for _ in range(2000))
    assert bad / 2000 < quality_rules.DELTA


def test_rules_keep_good_and_reject_junk(spark):
    clean = [f"plain sentence number {i} with ordinary words, and some more of them for good measure in row {i * 7}." for i in range(400)]
    junk = [" ".join(f"word{i}{j}###" for j in range(30)) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate([*clean, *junk, None, ""])], DOCS)
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(430)] * 2, LABELS)
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, labels).collect()}
    assert all(got[i]["kept"] for i in range(400)) and not any(got[i]["kept"] for i in range(400, 432))
    none = quality_rules.apply_rules(docs, labels.limit(0))
    assert none.where("cutoff is not null").count() == 0 and none.where("kept").count() == 430
    assert quality_rules.apply_rules(docs.limit(0), labels).count() == 0


def test_copies_and_contradictions_are_no_trials(spark):
    """A hundred copies of a text certify no more than one, and a document labelled both ways is not good."""
    plain = " ".join(f"word{i}" for i in range(40))
    texts = [plain] * 200 + [f"{plain} {i}" for i in range(200)]
    docs = documents(spark, texts, extra=["content", "severity"]).withColumn("lang", F.when(F.col("doc_id") < 200, "a").otherwise("b"))
    both = [(i, q, 0) for i in range(400) for q in (1, 1)]
    cut = lambda rows_: {r["stratum"]: r["cutoff"] for r in quality_rules.apply_rules(docs, spark.createDataFrame(rows_, "doc_id long, quality int, toxic int")).collect()}
    got = cut(both)
    assert got["a"] is None and got["b"] is not None
    assert cut([*both, *((i, 0, 0) for i in range(200, 400))])["b"] is None


@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_weighted_mix"])
def test_queries_against_sql(spark, sf, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == expected(ORACLE_SQL[name], sf)


# ---- classifier


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    scores = quality_model.score_documents(table(spark, sf, "documents"), labels)
    got = scores.where("held_out").join(labels, "doc_id").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert scores.where("score < 0 or score > 1 or (score >= 0.3) <> (predicted = 1)").count() == 0


def test_pairwise_fit_orders_and_cuts_at_the_quantile():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    good = (x @ [2.0, -1.0, 0.0] + 0.3 * rng.normal(size=500) > -1).astype(int)
    model = quality_model.fit(["a", "b", "c"], x, good)
    w = np.array([model.weights[k] for k in "abc"])
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * w[0]
    score = 1 / (1 + np.exp(-(x @ w * model.slope + model.shift)))
    assert abs((score < quality_model.THRESHOLD).mean() - (good == 0).mean()) < 0.01


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = documents(spark, [("fine words here " * 5 + str(i)) if i % 2 else "### $$$ %%% " * 6 for i in range(60)], extra=["score", "held_out", "good", "h"])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_model.score_documents(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_classifier_edges(spark):
    docs = documents(spark, ODD_TEXTS)
    one_kind = spark.createDataFrame([(i, 1, 0) for i in range(9)], LABELS)
    assert {r["score"] for r in quality_model.score_documents(docs, one_kind).collect()} == {0.5}
    assert quality_model.score_documents(docs, one_kind.limit(0)).count() == len(ODD_TEXTS)
    assert quality_model.score_documents(docs.limit(0), one_kind).count() == 0
    extra = documents(spark, ODD_TEXTS, extra=["n_words", "score", "__x"]).withColumn("more", F.array(F.lit(1.5)))
    kept = quality_model.accepted(extra, one_kind)
    assert kept.columns == extra.columns and kept.count() == len(ODD_TEXTS)


# ---- mix


def water_fill(sizes, weights, share=1.5, repeats=2):
    """Targets by giving out and sharing again until none is above its cap."""
    caps = {k: repeats * v for k, v in sizes.items()}
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0), {k for k in sizes if caps[k]}
    while left > 1e-9 and open_:
        total = sum(weights[k] for k in open_)
        for k in open_:
            target[k] += left * weights[k] / total
        left = sum(max(0, target[k] - caps[k]) for k in open_)
        for k in list(open_):
            if target[k] >= caps[k]:
                target[k] = caps[k]
                open_.discard(k)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, "c": 70}, {"a": 5, "b": 1000, "c": 10, "d": 3, "e": 400}, {"b": 10, "a": 0, None: 40}, {None: 7}])
def test_targets(spark, sizes):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (n // 2)) if n else None, "en", s, 0) for i, (s, n) in enumerate([(s, n if k else n + n % 2) for s, n in sizes.items() for k in (0, 1)])], DOCS)
    got = {r["source"]: r for r in mixing.source_targets(docs.select("source", mixing.word_count().alias("size"))).collect()}
    real = {s: r["source_size"] for s, r in got.items()}
    order = sorted(real, key=lambda s: (s is None, s or ""))
    want = water_fill(real, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    assert {s: r["target"] for s, r in got.items()} == pytest.approx(want)


def test_mix_meets_targets_and_repeats_itself(spark, sf):
    docs = table(spark, sf, "documents")
    a = mixing.mix(docs)
    got = a.toPandas()
    assert (got["taken"] <= 2 * got["size"]).all()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per["taken"] - per["target"]) <= mixing.QUANTUM).all()  # the packet in service at the end
    assert abs(per["taken"].sum() - per["target"].sum()) <= 1
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, mixing.mix(docs.repartition(5)).select(*key).collect()))


def test_stream_is_in_order_of_virtual_time(spark, sf):
    docs = table(spark, sf, "documents")
    rows_ = mixing.stream(mixing.plan(docs)).collect()
    finish = [r["finish"] for r in rows_]
    assert finish == sorted(finish) and sum(r["words"] for r in rows_) == mixing.mix(docs).agg(F.sum("taken")).first()[0]
    total = rows_[0]["all_targets"]
    assert abs(sum(r["words"] for r in rows_) - total) <= len({r["source"] for r in rows_})
    half = sum(r["words"] for r in mixing.stream(mixing.plan(docs), budget=total / 2).collect())
    assert abs(half - total / 2) <= len({r["source"] for r in rows_})


def test_the_order_of_the_stream_decides(spark, sf, monkeypatch):
    """Without virtual finish times, the same budget takes other words, far from the targets."""
    docs = table(spark, sf, "documents")
    straight = mixing.mix(docs).toPandas()
    made = mixing.packets
    monkeypatch.setattr(mixing, "packets", lambda *a: made(*a).withColumn("finish", F.rand(3)))
    mixed = mixing.mix(docs).toPandas()
    assert abs(mixed["taken"].sum() - straight["taken"].sum()) <= 1
    assert sorted(mixed["taken"]) != sorted(straight["taken"])


def test_mix_equals_a_plain_queue(spark, sf):
    """Packets one after another, by a sort of them all in one list."""
    docs = table(spark, sf, "documents")
    rows_ = [r.asDict() for r in mixing.plan(docs).collect()]
    queue = []
    for r in rows_:
        for k in range(2):
            for at in range(0, r["size"], mixing.QUANTUM):
                n = min(mixing.QUANTUM, r["size"] - at)
                begun = r["source_size"] * k + r["start"] + at
                if r["target"]:
                    queue.append(((begun + n) / r["target"], r["source"] is None, r["source"] or "", k, r["key"], r["doc_id"], r["size"], at, n))
    left, taken = int(rows_[0]["all_targets"] + 0.5), {}
    for *_, doc, _, _, n in sorted(queue):
        taken[doc] = taken.get(doc, 0) + min(n, left)
        left -= min(n, left)
    got = {}
    for r in mixing.mix(docs).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["taken"]
    assert got == {d: taken.get(d, 0) for d in got}


def test_mix_edges(spark):
    docs = documents(spark, ODD_TEXTS, extra=["size", "key", "target", "bucket", "start"])
    got = mixing.mix(docs).collect()
    assert len(got) == len(ODD_TEXTS) and all(r["taken"] == 0 for r in got if not r["size"])
    assert mixing.mix(docs.limit(0)).count() == 0
    same = documents(spark, ["five words are in here"] * 8, sources=["a"], ids=[1] * 8)
    mixed = mixing.mix_documents(same)
    assert mixed.columns == same.columns and 11 <= mixed.count() <= 13
    assert mixing.mix_documents(docs).columns == docs.columns
