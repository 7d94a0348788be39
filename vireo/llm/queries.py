"""Queries over the generated tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, embedding_join, filter_audit, langid, line_dedup, lm_score, mixing, ngram_join, quality, suffix_dedup, token_counts, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(_read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_read(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_tokens")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score_texts(_read(spark, sf_dir, "documents"), langid.fold("doc_id", 10) != 0, keep=["doc_id"])
    return scored.select("doc.doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, prototypes = langid.learn_prototypes(docs.filter(langid.fold("doc_id", 4) != 2))
    held = docs.withColumn("held_out", langid.fold("doc_id", 4) == 2)
    return langid.identify_languages(held, langs, prototypes, keep=["doc_id", "held_out"])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(_read(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_ngram_join, op3_suffix_dedup, op4_token_counts, op5_decontaminate, op6_quality, op7_embedding_near_dup, op8_warc, op9_lm_score, op10_language_id, op11_filter_audit, op12_phrases, op13_line_dedup)}
SQL = {"op1_mix_sources": mixing.SQL, "op2_ngram_join": ngram_join.SQL, "op3_suffix_dedup": suffix_dedup.SQL, "op5_decontaminate": decontaminate.SQL, "op7_embedding_near_dup": embedding_join.SQL, "op8_warc": warc.SQL, "op11_filter_audit": filter_audit.SQL, "op12_phrases": collocations.SQL, "op13_line_dedup": line_dedup.SQL}
