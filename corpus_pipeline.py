"""A training corpus from raw documents, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again. All but
the last return the columns of ``documents``. The stages learn (languages, quality
rules, domains) from the documents they are given and from the labels table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import langid, mixing, neardup, pieces, quality
from topicloom.llm.common import apart, saved, text_batches, together
from topicloom.llm.queries import DOMAINS, labelled_domains, piece_model, table

# Below this a text is of no language that was learned.
MIN_LANGUAGE_SCORE = 0.45


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that was learned; texts without letters or of no
    recognised language go."""
    text_batches(spark)
    found = langid.with_language(apart(docs, "doc_id", "text", "lang"))
    known = (F.col("_language.lang_pred") != langid.UNKNOWN) & (F.col("_language.score") >= MIN_LANGUAGE_SCORE)
    return together(found.where(known), docs, "doc_id", "text", "lang")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and no rule learned from the labels finds."""
    text_batches(spark)
    counted = saved(apart(docs, "doc_id", "text").withColumn("_counts", quality.text_counts(F.col("text"))), "counted")
    rules = quality.rules_from(counted, table(spark, sf_dir, "labels"))
    return together(quality.judged(counted, rules).where("_quality.kept"), docs, "doc_id", "text")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    text_batches(spark)
    return neardup.one_of_each(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says: rarely where too much of a domain is there."""
    labelled = labelled_domains(table(spark, sf_dir, "labels"))
    rated = mixing.mixed(apart(docs, "doc_id", "text"), labelled, DOMAINS)
    times = mixing.copies(F.col("rate"), F.col("doc_id"), F.col("text"))
    return together(rated.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))), docs, "doc_id", "text")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    text_batches(spark)
    return pieces.encoded(docs, piece_model(), digests_only=True)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing_to_targets", mixing_to_targets),
    ("sentencepiece", sentencepiece),
]

# Learned models and connected groups are not SQL; tests compare the stages with
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
