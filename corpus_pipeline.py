"""A training corpus from raw documents, in five stages of the training-data operators.

Each stage takes (spark, documents, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and reads it back as the next stage's documents. All stages but the last return the columns
of documents: the quality classifier drops what it rejects, the Jaccard join leaves one document of each
group, the secret scan replaces secrets by a mark, the mix repeats or leaves out documents to meet its
targets, and the last stage turns texts into token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinweave.llm import bpe, jaccard_join, mixing, quality_model, secret_scan
from twinweave.llm.common import table
from twinweave.llm.queries import BPE_VOCABULARY
from twinweave.llm.shingles import Measure
from twinweave.operators.checkpoints import discard, materialise
from twinweave.workers import reachable

#: Near copies share four fifths of their five-word shingles.
STAGE_MEASURE = Measure(width=5, num=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return quality_model.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return jaccard_join.keep_one(docs, STAGE_MEASURE)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return secret_scan.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return bpe.tokenised(docs, BPE_VOCABULARY)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]

#: No SQL: the stages learn models and run a tokenizer; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = materialise(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = made
    return docs
