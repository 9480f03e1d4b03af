"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timetide.llm import bpe, hamming, jaccard, langid, licenses, mixing, pieces, quality, quality_rules, runs, substrings, toxicity, whitening
from timetide.llm.textops import crc_of_id

#: The vocabulary of op9; bpe_encode takes any other path.
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))
#: The model of op12; piece_encode takes any other path.
PIECE_MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of_id(), F.lit(4)) == 2
    model = langid.fit_on(docs.filter(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def _scored(docs: DataFrame, labels: DataFrame, part, score, threshold: float) -> DataFrame:
    """Fit on the labels that are not held out, and score every document."""
    held_out = F.pmod(crc_of_id(), F.lit(5)) == 0
    rows = score(docs, part.fit_on(docs, labels.filter(~held_out)))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity, toxicity.score_toxicity, 0.5)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality, quality.score_quality, 0.3)


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(points, points.filter(F.col("id") % 100 == 0), k=10)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op7_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each one links with, inside its component."""
    return jaccard.link_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = substrings.dedup_substrings(docs, digest=True)
    return rows.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__kept").alias("kept_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.repeat_tails(table(spark, sf_dir, "documents"))))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_encode(table(spark, sf_dir, "documents"), PIECE_MODEL, with_ids=False)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_hamming_top_k": op3_hamming_top_k,
    "op4_quality": op4_quality,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_jaccard_join": op7_jaccard_join,
    "op7_jaccard_links": op7_jaccard_links,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_bpe": op9_bpe,
    "op10_license_scan": op10_license_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_pieces": op12_pieces,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op3_hamming_top_k": hamming.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_jaccard_join": jaccard.ORACLE,
    "op8_substring_dedup": substrings.ORACLE,
    "op10_license_scan": licenses.ORACLE,
}
