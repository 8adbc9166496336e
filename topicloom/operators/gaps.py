"""Coverage-gap reports over topic clusters.

The classes and report names are given; how far is "far" and what a class weighs
is not, so cut-offs, age and weights are arguments.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.schemas import REVIEW_STATUSES

DEFAULT_WEIGHTS = {"missing": 1.0, "outdated": 0.7, "weak": 0.5, "good_coverage": 0.0}


def classify_gaps(topics: DataFrame, missing_beyond: float, weak_beyond: float,
                  outdated_before: datetime | Column) -> DataFrame:
    """Add ``classification`` from the nearest article's distance and age.

    ``topics`` has distance and updated_at of the nearest article, null if none.
    """
    if weak_beyond > missing_beyond:
        raise ValueError("weak_beyond must not exceed missing_beyond")
    limit = outdated_before if isinstance(outdated_before, Column) else F.lit(outdated_before)
    distance = F.col("distance")
    return topics.withColumn(
        "classification",
        F.when(distance.isNull() | (distance > missing_beyond), "missing")
        .when(distance > weak_beyond, "weak")
        .when(F.col("updated_at") < limit, "outdated")
        .otherwise("good_coverage"),
    )


def gap_volume(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("account_id", "run_id", "classification").agg(
        F.count(F.lit(1)).alias("topics"), F.sum("ticket_count").alias("ticket_volume"))


def prioritize(gaps: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Add ``priority_score`` (volume times class weight) and its rank within the run."""
    weight = F.lit(0.0)
    for name, value in weights.items():
        weight = F.when(F.col("classification") == name, F.lit(float(value))).otherwise(weight)
    scored = gaps.withColumn("priority_score", F.col("ticket_count") * weight)
    # Ranked by distinct scores, so that a run with most topics is no single task's sort.
    run = ["account_id", "run_id"]
    scores = scored.groupBy(*run, "priority_score").agg(F.count(F.lit(1)).alias("_same"))
    lower = Window.partitionBy(*run).orderBy("priority_score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_same").over(lower), F.lit(0))
    others = F.sum("_same").over(Window.partitionBy(*run)) - 1
    ranks = scores.select(*run, "priority_score", F.when(others > 0, below / others).otherwise(0.0).alias("priority_rank"))
    return scored.join(ranks, [*run, "priority_score"]).select(*scored.columns, "priority_rank")


def dashboard_lists(gaps: DataFrame, count: int = 10) -> DataFrame:
    """Top topics of each list: missing articles, most repeated, needing update."""
    lists = F.array_compact(F.array(
        F.when(F.col("classification") == "missing", "top_missing"),
        F.lit("most_repeated"),
        F.when(F.col("classification").isin("weak", "outdated"), "needs_update"),
    ))
    order = Window.partitionBy("account_id", "run_id", "list").orderBy(
        F.desc("ticket_count"), "cluster_id")
    listed = gaps.withColumn("list", F.explode(lists))
    return listed.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= count)


def review_funnel(drafts: DataFrame) -> DataFrame:
    """Drafts per account and review status, one column per status."""
    counts = [
        F.count_if(F.col("review_status") == status).alias(status) for status in REVIEW_STATUSES
    ]
    return drafts.groupBy("account_id").agg(*counts)
