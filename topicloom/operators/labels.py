"""Cluster labels: representatives, masked excerpts, model or extractive labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import (
    excerpt_block,
    label_prompt,
    mask_pii,
    parse_label,
    parse_summary,
)
from topicloom.operators.models import Generate, generate_texts
from topicloom.operators.sizes import saved_by_small_tasks

# --- Fixed values: excerpt count and the label of a failed call ---
REPRESENTATIVES = 5
FALLBACK_LABEL = "Unlabeled cluster"
# --- end of fixed values ---

CLUSTER = ("account_id", "run_id", "cluster_id")
WORD_PATTERN = r"[\p{L}\p{N}]+"
SCORE_DECIMALS = 6


def representatives(members: DataFrame, count: int = REPRESENTATIVES,
                    cluster: Sequence[str] = CLUSTER, id_col: str = "ticket_id") -> DataFrame:
    """First members by id, numbered from 1; tasks drop the rest before shuffling."""
    order = Window.partitionBy(*cluster).orderBy(id_col)
    return members.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= count)


def excerpts(chosen: DataFrame, tickets: DataFrame, cluster: Sequence[str] = CLUSTER,
             on: Sequence[str] = ("account_id", "ticket_id")) -> DataFrame:
    """Masked text of each cluster's representatives; masked once, when joined.

    ``chosen`` holds a handful of rows per cluster, so the list stays short.
    Representatives without a stored ticket drop out and the rest close up.
    """
    found = chosen.join(tickets.select(*on, "subject", "description"), list(on))
    row = F.struct("position", "subject", "description")
    rows = F.array_sort(F.collect_list(row))
    blocks = F.transform(
        rows, lambda r, i: excerpt_block(i + 1, r["subject"], r["description"]))
    joined = found.groupBy(*cluster).agg(F.array_join(blocks, "\n\n").alias("raw"))
    return joined.select(*cluster, mask_pii(F.col("raw")).alias("masked_excerpts"))


def label_by_model(masked: DataFrame, build: Callable[[], Generate],
                   cluster: Sequence[str] = CLUSTER) -> DataFrame:
    """Label and summary from a text model; a failed call keeps the cluster."""
    prompts = masked.select(*cluster, label_prompt(F.col("masked_excerpts")).alias("prompt"))
    answered = generate_texts(prompts, "prompt", build)
    failed = F.col("error").isNotNull()
    return answered.select(
        *cluster,
        F.when(failed, FALLBACK_LABEL).otherwise(parse_label(F.col("answer"))).alias("label"),
        F.when(failed, "").otherwise(parse_summary(F.col("answer"))).alias("summary"),
        "error",
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def term_scores(texts: DataFrame, clusters: DataFrame, text_col: str = "text",
                cluster: Sequence[str] = CLUSTER, scope: Sequence[str] = ("account_id", "run_id"),
                min_length: int = 1) -> DataFrame:
    """TF-IDF of every word of a cluster, with clusters as the documents.

    ``clusters`` lists the clusters of each scope, one row each. Counts are
    merged before the shuffle, so frequent words and large clusters cost one row
    per task; a word's spread is then counted over at most one row per cluster.
    The texts are read and split once.
    """
    counts = (
        texts.select(*cluster, F.explode(words(F.col(text_col))).alias("term"))
        .filter(F.length("term") >= min_length)
        .groupBy(*cluster, "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    # Counted and joined back, not windowed: adaptive execution can split a frequent word.
    spread = counts.join(counts.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df")), [*scope, "term"])
    total = clusters.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return spread.join(total, list(scope)).select(
        *cluster, "term", "tf", "df",
        F.round(F.col("tf") * idf, SCORE_DECIMALS).alias("score"))


def keywords(scores: DataFrame, count: int = 5, cluster: Sequence[str] = CLUSTER) -> DataFrame:
    """Best words per cluster, ranked; equal scores go by the alphabet.

    Computed before this returns, as scores are many and the best few are few.
    """
    order = Window.partitionBy(*cluster).orderBy(F.desc("score"), "term")
    best = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)
    return saved_by_small_tasks(best, "keywords")


def extractive_labels(scores: DataFrame, count: int = 3, cluster: Sequence[str] = CLUSTER) -> DataFrame:
    """Offline label: the best words of a cluster, in order."""
    best = keywords(scores, count, cluster)
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"])
    return best.groupBy(*cluster).agg(F.array_join(ordered, " ").alias("label"))
