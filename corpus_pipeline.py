"""A corpus pipeline over documents: toxicity, near-duplicates, benchmark leaks, personal data, encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import decontaminate, near_copies, pii, sentence_pieces, toxicity
from cardloom.llm.common import Saved, fresh, scratch, table


def _apart(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """docs without columns of these names, which an operator adds: renamed; and each column of docs under its own name."""
    new = {}
    for c in docs.columns:
        if c.lower() in names:
            new[c] = fresh(f"{c}_given", [*docs.columns, *new.values()])
    return docs.withColumnsRenamed(new), {c: F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it is fitted on labelled documents of this stage's input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    inner, own = _apart(docs, ("score", "predicted"))
    return toxicity.scored(inner, model).filter("predicted = 0").select(*own.values())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, five-word Jaccard 0.8 or more: that with the least id.

    Rows without an id are known by their text and come after real ids. Of a group's rows with the least id, the one
    whose columns have the least hash stays. Rows that share an id but aren't near-duplicates are of different groups,
    and each stays; rows that are equal in all columns are one.
    """
    own, row = (fresh(c, docs.columns) for c in ("own_id", "own_row"))
    by_text = F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 61))
    known = F.coalesce(F.col("doc_id").cast("long"), by_text).alias(own)
    named = docs.select("*", known, F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind)).alias(row))
    found = near_copies.near_copies(named.select(F.col(own).alias("doc_id"), F.col(row).alias("row_id"), "text"))
    least = F.min(F.struct(F.col("doc_id").alias(own), F.col("row_id").alias(row))).alias("least")
    first = Saved(found.groupBy("root").agg(least).select("least.*"), "first").df
    return named.join(first, [own, row], "left_semi").dropDuplicates([own, row]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item. They are told apart by text, so rows that share an id aren't mixed up."""
    key = fresh("own_text", docs.columns)
    named = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    leaks = decontaminate.contaminated(named.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = Saved(leaks.select(F.col("doc_id").alias(key)).distinct(), "leaks").df
    return named.join(leaks, key, "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it masked in text, and n_chars of the new text."""
    inner, own = _apart(docs, pii.COLUMNS)
    new = {"text": F.col("clean_text").alias("text"), "n_chars": F.coalesce(F.length("clean_text"), F.lit(0)).cast("long").alias("n_chars")}
    return pii.sanitise(inner).select(*(new.get(c, as_given) for c, as_given in own.items()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, ids_sha256 and round_trip of all documents."""
    return sentence_pieces.encoded(docs, keep=("lang", "source"), remember=200_000, pairs=600_000)  # beside what the stages before have left in memory


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("sentence_pieces", encode),
]
#: SQL can't express the classifier, the components, the sanitisation or the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result on documents; each stage's output is written to the shared folder and read again.

    What a stage has written for itself goes when its output is there, and that goes when the next one's is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            kept.append(out := Saved(stage(spark, docs, sf_dir), name))
        if before:
            before.drop()
        docs, before = out.df, out
    return STAGES[-1][1](spark, docs, sf_dir)
