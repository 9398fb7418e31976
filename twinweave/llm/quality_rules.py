"""Risk-controlled quality rules (operator 2).

Every text gets a severity: the largest of several statistics, each divided by the value at which it is
clearly unusual. A stratum (by default a language) rejects above a cutoff. Cutoffs are chosen on labelled
holdouts: from the most lenient on, nested cutoffs are tested in a fixed order against "more than ALPHA of
the stratum's good documents are rejected", by the exact binomial tail, each stratum at level DELTA divided
by the number of strata (Bonferroni); the last cutoff of an unbroken run of passes is kept. A fixed order
of nested tests needs no further correction. So with confidence 1 - DELTA, of the good documents that pass the
base rules no stratum's cutoff rejects more than ALPHA; what the base rules themselves reject is fixed and no part
of this. Trials are distinct texts, as copies are not independent. A stratum with too few labels to certify anything
rejects nothing.

Holdout counts per stratum and cutoff come from one aggregation; what reaches the driver is one row for
each stratum and cutoff. Defined results: null texts are empty (all counts 0, base_failed); null strata are
one stratum; documents without a label count in no test; repeated labels count once, and a document that is labelled
both ways is not good; an empty label table certifies nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm.text_stats import with_stats
from twinweave.operators.checkpoints import materialise

ALPHA = 0.03
DELTA = 0.05
#: Nested cutoffs of the severity, the most lenient first.
CUTOFFS = (8.0, 6.0, 4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0)
#: The value of each statistic at which a text is clearly unusual.
UNUSUAL = {"symbols": 0.1, "pipes": 0.05, "bangs": 0.1, "upper": 0.25, "repeats": 0.2, "adjacent": 0.1, "dup_lines": 0.3}


def severity() -> Column:
    """Largest statistic over its unusual value; ratios are damped on texts of a few words."""
    words = F.col("n_words") + 5
    stats = {
        "symbols": F.col("n_symbols") / words,
        "pipes": F.col("n_pipes") / words,
        "bangs": F.col("n_bangs") / words,
        "upper": F.col("n_upper") / (F.col("n_upper") + F.col("n_lower") + 20),
        "repeats": F.col("n_repeat_words") / words,
        "adjacent": F.col("n_adjacent") / words,
        "dup_lines": F.col("n_dup_lines") / (F.col("n_lines") + 1),
    }
    return F.greatest(*[v / F.lit(UNUSUAL[k]) for k, v in stats.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly summed."""
    if k >= n:
        return 1.0
    log_p, log_q = math.log(p), math.log1p(-p)
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper confidence bound of a rate with k of n seen."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > delta else (low, mid)
    return high


def choose(counts: list[tuple[str | None, int, list[int]]], alpha: float = ALPHA, delta: float = DELTA) -> dict[str | None, float]:
    """Cutoff of each stratum from (stratum, good holdouts, how many of them each cutoff rejects); certified ones only."""
    level = delta / max(1, len(counts))
    out = {}
    for stratum, n, rejected in counts:
        for cutoff, k in zip(CUTOFFS, rejected, strict=True):
            if n == 0 or binomial_tail(k, n, alpha) > level:
                break
            out[stratum] = cutoff
    return out


def apply_rules(documents: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed, severity, the stratum's certified cutoff (null: none) and kept, for every document."""
    stats = with_stats(documents.select("doc_id", F.col(stratum).cast("string").alias("stratum"), F.xxhash64("text").alias("content"), "text"), ["doc_id", "stratum", "content"])
    stats = materialise(stats.withColumn("severity", severity()).withColumn("base_failed", base_failed()), "rules")
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = 1 and high = 1")
    holdout = stats.where(~F.col("base_failed")).join(good, "doc_id", "left_semi").select("stratum", "content", "severity").distinct()
    rows = holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") > c).alias(f"k{i}") for i, c in enumerate(CUTOFFS)]).collect()
    cutoffs = choose([(r["stratum"], r["n"], [r[f"k{i}"] for i in range(len(CUTOFFS))]) for r in rows], alpha, delta)
    chosen = documents.sparkSession.createDataFrame([(s, c) for s, c in cutoffs.items()], "certified string, cutoff double")
    out = stats.join(chosen, F.col("stratum").eqNullSafe(F.col("certified")), "left").drop("certified", "content")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("cutoff").isNull() | (F.col("severity") <= F.col("cutoff"))))
