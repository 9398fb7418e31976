"""The registered queries of the training-data operators: thin applications to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm import bpe, filter_audit, hard_negatives, html_blocks, jaccard_join, license_scan, mixing, oracles, quality_model, quality_rules, secret_scan, sentence_pieces, suffix_tree, webp
from twinweave.llm.common import table

#: Where the vocabulary of operator 6 lies; give another path to use another file.
BPE_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The same for the model of operator 13.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.read_back(webp.store(table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "severity", "cutoff")


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_pages(table(spark, sf_dir, "pages"))


def op4_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BPE_VOCABULARY)


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=moved).drop("positive_rank")


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


QUERIES = {
    f.__name__: f
    for f in (
        op1_webp, op2_quality_rules, op3_html_blocks, op4_weighted_mix, op5_secret_scan, op6_bpe, op7_quality_model, op8_suffix_tree, op9_license_scan, op10_jaccard_join,
        op11_filter_audit, op12_hard_negatives, op13_sentence_pieces,
    )
}

ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)
