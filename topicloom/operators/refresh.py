"""Incremental article refresh: which articles need a new embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import is_blank
from topicloom.operators.ingest import ARTICLE_UPDATE_COLS
from topicloom.operators.upsert import upsert

KEYS = ["account_id", "article_id"]
EMBEDDED, SKIPPED = "embedded", "skipped"
MODES = ("by_version", "by_missing")


def route_articles(incoming: DataFrame, stored: DataFrame, mode: str = "by_version") -> DataFrame:
    """Add ``action`` and ``reason`` to incoming articles.

    ``stored`` is the state *before* this batch is merged, else every article
    would look unchanged against itself. With ``by_version`` an article whose
    earlier embedding failed stays unembedded until its version changes;
    ``by_missing`` also embeds whatever has no vector yet.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    known = stored.select(*KEYS, F.col("updated_at").alias("_stored_at"), F.col("embedding").isNull().alias("_no_vector"))
    again = F.col("_no_vector") if mode == "by_missing" else F.lit(False)
    routed = incoming.join(known, KEYS, "left")
    return with_action(routed, F.col("_stored_at"), again).drop("_stored_at", "_no_vector")


def with_action(articles: DataFrame, stored_at: Column, again: Column | None = None) -> DataFrame:
    """``articles`` with ``reason`` and ``action``, given the version stored before each;
    ``again`` marks those to embed though their version is the stored one."""
    to_ms = lambda at: F.date_trunc("MILLISECOND", at)
    unchanged = to_ms(stored_at) == to_ms(F.col("updated_at"))
    if again is not None:
        unchanged = unchanged & ~again
    reason = (
        F.when(F.col("draft"), "draft")
        .when(is_blank(F.col("clean_text")), "blank")
        .when(unchanged, "unchanged")
        .when(stored_at.isNull(), "new")
        .otherwise("changed")
    )
    action = F.when(F.col("reason").isin("new", "changed"), EMBEDDED).otherwise(SKIPPED)
    return articles.withColumn("reason", reason).withColumn("action", action)


def refresh_counts(routed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return routed.groupBy(*(keys or ["account_id"])).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("action") == EMBEDDED).alias("embedded"),
        F.count_if(F.col("action") == SKIPPED).alias("skipped"),
    )


def merge_articles(stored: DataFrame, routed: DataFrame, vectors: DataFrame) -> DataFrame:
    """Next table version: metadata of all incoming, vectors of the embedded ones.

    ``vectors``: account_id, article_id, embedding, embedded_at.
    """
    metadata = routed.select(*KEYS, *ARTICLE_UPDATE_COLS)
    merged = upsert(stored, metadata, KEYS, ARTICLE_UPDATE_COLS)
    return upsert(merged, vectors, KEYS, ["embedding", "embedded_at"], insert=False)
