"""The registered queries of this package: each applies its operator to the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lattice_lm, pii, quality_classifier, quality_rules, sentence_pieces, simhash, substring_dedup, toxicity, url_filter
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encoded(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "round_trip")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"), with_text=False)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, *quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scores(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


QUERIES = {"op1_simhash": op1_simhash, "op2_pii": op2_pii, "op3_decontaminate": op3_decontaminate, "op4_sentence_pieces": op4_sentence_pieces, "op5_quality_rules": op5_quality_rules, "op6_toxicity": op6_toxicity, "op7_substring_dedup": op7_substring_dedup, "op8_quality_classifier": op8_quality_classifier, "op9_lattice_lm": op9_lattice_lm, "op10_url_filter": op10_url_filter}
ORACLE: dict[str, str] = {"op3_decontaminate": decontaminate.oracle_sql(), "op7_substring_dedup": substring_dedup.oracle_sql(), "op10_url_filter": url_filter.oracle_sql()}
