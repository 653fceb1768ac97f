"""The numbered queries, each an operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, hmm, html_extraction, jaccard_join, language_id, mixing, neighbours, phrases, quality, secrets, suffix_dedup, token_counts
from .common import crc_bucket, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.find_secrets(table(spark, sf_dir, "documents"), model)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(crc_bucket(F.col("doc_id"), 4) != 2))
    out = language_id.identify(docs, model, ["doc_id"])
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(crc_bucket(F.col("doc_id"), 5) != 0))
    out = quality.score(docs, model, ["doc_id"])
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm.score_texts(table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 7) != 2)
    held = (crc_bucket(F.col("doc_id"), 7) == 2).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extraction.extract_pages(pages, html_extraction.train(pages))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # the installed vocabulary files

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_source_mixing": op3_source_mixing,
    "op4_language_id": op4_language_id,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_hmm_scoring": op9_hmm_scoring,
    "op10_html_extraction": op10_html_extraction,
    "op11_token_counts": op11_token_counts,
    "op12_source_divergence": op12_source_divergence,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLES = {
    "op3_source_mixing": mixing.SQL.format(docs="documents"),
    "op12_source_divergence": divergence.SQL.format(docs="documents"),
    "op13_phrase_collocations": phrases.SQL.format(docs="documents"),
}
