"""Quality classifier by Bradley-Terry pairwise ranking (operator 7).

A document's worth is linear in features of its whole text. From labelled rows, preference pairs (a good
document over a bad one) are drawn, and the weights minimise the logistic loss of the feature differences
(Newton steps with an L2 penalty). The cutoff is a quantile of the training documents' worth: that at the
share of bad ones. A slope fitted to the labels turns worth into a score between 0 and 1, shifted so that
the cutoff is scored THRESHOLD.

Only training rows whose crc32 of the id, modulo 5, is not 0 are learned from, at most TRAIN_ROWS of them
(the lowest hashes; a bounded sample, so the fit runs on the driver). Features never see label, language,
source or id. Defined results: null texts are empty; empty texts get the score of their (zero) features;
without both labels all scores are 0.5; repeated label rows count once; ties score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import crc_mod
from twinweave.llm.text_stats import stats_column, with_stats

TRAIN_ROWS = 20_000
PAIRS = 100_000
THRESHOLD = 0.3
FOLDS = 5


def features(at: str = "") -> dict[str, Column]:
    """Bounded ratios of the counts (columns with the prefix ``at``), damped on texts of a few words; square roots bring small values apart."""
    c = lambda name: F.col(at + name)
    n = c("n_words") + 10
    letters = c("n_upper") + c("n_lower") + 20
    ratios = {
        "symbols": c("n_symbols") / n,
        "pipes": c("n_pipes") / n,
        "bangs": c("n_bangs") / n,
        "upper": c("n_upper") / letters,
        "digits": c("n_digits") / letters,
        "unique": 1 - (c("n_unique_words") + 10) / n,
        "repeats": c("n_repeat_words") / n,
        "adjacent": c("n_adjacent") / n,
        "dup_lines": c("n_dup_lines") / (c("n_lines") + 2),
        "unended": F.lit(1) - c("n_ends") / n,
    }
    out = {k: F.least(v, F.lit(1.0)) for k, v in ratios.items()}
    out |= {f"root_{k}": F.sqrt(F.greatest(out[k], F.lit(0.0))) for k in ("symbols", "pipes", "bangs", "upper", "repeats", "adjacent")}
    out["long_words"] = F.least(F.abs(c("word_chars") / F.greatest(c("n_words"), F.lit(1)) - 5) / 10, F.lit(1.0))
    out["short"] = 1 / (1 + c("n_words") / 10)
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights by feature, and the slope and shift that turn worth into a score."""

    weights: dict[str, float]
    slope: float
    shift: float

    def score(self, columns: dict[str, Column]) -> Column:
        worth = sum((columns[k] * F.lit(w) for k, w in self.weights.items()), F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.least(worth * self.slope + self.shift, F.lit(35.0)), F.lit(-35.0))))


def fit(names: list[str], x: np.ndarray, good: np.ndarray, seed: int = 1, penalty: float = 1e-3) -> Ranking:
    """Learn from a matrix of features and a vector of labels; a constant score without both labels."""
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(up) or not len(down):
        return Ranking({}, 1.0, 0.0)
    rng = np.random.default_rng(seed)
    a = np.concatenate([up[rng.integers(0, len(up), PAIRS)], up])
    b = np.concatenate([down[rng.integers(0, len(down), PAIRS)], down[rng.integers(0, len(down), len(up))]])
    d = x[a] - x[b]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w)), d.T @ (p - 1) / len(d) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    worth = x @ w
    # between the highest worth below the quantile and the lowest above it
    order = np.sort(worth)
    at = min(max(len(down), 1), len(order) - 1)
    cut = (order[at - 1] + order[at]) / 2
    slope = 1.0
    for _ in range(50):  # one-dimensional logistic fit of the slope about the cutoff, lightly held back
        z = worth - cut
        p = 1 / (1 + np.exp(-np.clip(slope * z, -35, 35)))
        step = (np.mean((p - good) * z) + 1e-4 * slope) / (np.mean(p * (1 - p) * z * z) + 1e-4)
        slope = min(max(slope - step, 0.05), 50.0)
        if abs(step) < 1e-9:
            break
    return Ranking(dict(zip(names, w.tolist(), strict=True)), float(slope), float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Ranking:
    """Fit on the documents of at most ``rows`` labels outside the held-out fold: those of the lowest hashes."""
    marks = labels.where(crc_mod("doc_id", FOLDS) != 0).where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).distinct()
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(rows)
    columns = features()
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")  # at most ``rows`` pairs of numbers
    stats = with_stats(known, ["doc_id", "good"])
    got = stats.select(*[v.alias(k) for k, v in columns.items()], "good", "doc_id").orderBy("doc_id", "good", *columns).limit(2 * rows).collect()
    names = list(columns)
    return fit(names, np.array([[float(r[k]) for k in names] for r in got]).reshape(len(got), len(names)), np.array([r["good"] for r in got]))


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; one narrow pass after the fit."""
    score = train(documents, labels).score(features())
    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False))
    out = with_stats(documents.select("doc_id", "text"), ["doc_id"]).select("doc_id", held_out.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns, whatever their names."""
    score = train(documents, labels).score(features("stats."))
    return documents.select(F.struct("*").alias("d"), stats_column().alias("stats")).where(score >= THRESHOLD).select("d.*")
