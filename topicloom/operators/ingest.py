"""From feed records to stored tickets and articles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import html_to_text, normalized_title

# --- Fixed values: analysis windows, triage titles, article look-back ---
WINDOW_DAYS = (30, 60, 90)
TRIAGE_TITLES = ("category", "intent", "sentiment")
ARTICLE_LOOKBACK_DAYS = 3650
# --- end of fixed values ---

TICKET_UPDATE_COLS = (
    "run_id", "subject", "description", "first_comment", "status", "tags", *TRIAGE_TITLES,
)
ARTICLE_UPDATE_COLS = (
    "title", "clean_text", "section_id", "locale", "draft", "created_at", "updated_at",
)


def check_window(days: int) -> int:
    if days not in WINDOW_DAYS:
        allowed = ", ".join(map(str, WINDOW_DAYS))
        raise ValueError(f"a window of {days} days is not one of {allowed}")
    return days


def window_start(as_of: datetime | Column, days: int) -> Column:
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return at - F.make_dt_interval(F.lit(days))


def in_window(df: DataFrame, created_col: str, as_of: datetime | Column, days: int) -> DataFrame:
    """Rows created in the last ``days`` before ``as_of``, boundary included.

    The feed filters by update time and also returns old rows that were merely
    touched; rows without a creation time go too.
    """
    start = window_start(as_of, check_window(days))
    return df.filter(F.col(created_col) >= start)


def epoch_seconds(at: Column) -> Column:
    return F.unix_seconds(at.cast("timestamp"))


def triage_fields(fields: DataFrame) -> DataFrame:
    """Field id per account and triage title; of equal titles the last one wins.

    ``fields``: account_id, id, title, ordinal (position in the feed).
    """
    named = fields.withColumn("title", normalized_title(F.col("title")))
    return (named.filter(F.col("title").isin(*TRIAGE_TITLES))
            .groupBy("account_id", "title")
            .agg(F.max_by("id", "ordinal").alias("field_id")))


def triage_dimension(fields: DataFrame) -> DataFrame:
    """One row per account: the ids of its three triage fields."""
    ids = [
        F.max(F.when(F.col("title") == title, F.col("field_id"))).alias(f"{title}_field")
        for title in TRIAGE_TITLES
    ]
    return triage_fields(fields).groupBy("account_id").agg(*ids)


def text_value(custom_fields: Column, field_id: Column) -> Column:
    """Value of the first entry with this id, if that value is a string."""
    value = F.get(F.filter(custom_fields, lambda f: f["id"] == field_id), F.lit(0))["value"]
    text = F.try_variant_get(value, "$", "string")
    return F.when(F.schema_of_variant(value) == "STRING", text)


def with_triage(tickets: DataFrame, dimension: DataFrame) -> DataFrame:
    """Add the triage columns. The dimension has one row per account.

    Tenants are few beside their tickets, but their number is not bounded: the
    join is left to adaptive execution unless the caller marks the dimension
    with ``broadcast_if_small``.
    """
    joined = tickets.join(dimension, "account_id", "left")
    for title in TRIAGE_TITLES:
        joined = joined.withColumn(title, text_value(F.col("custom_fields"), F.col(f"{title}_field")))
    return joined.drop(*[f"{title}_field" for title in TRIAGE_TITLES])


def map_tickets(feed: DataFrame) -> DataFrame:
    """Feed records to ticket columns; the first comment is the description."""
    carried = ("account_id", "run_id", "generated_timestamp", "position", *TRIAGE_TITLES)
    kept = [c for c in carried if c in feed.columns]
    return feed.select(
        *kept,
        F.col("id").alias("ticket_id"),
        "subject", "description",
        F.col("description").alias("first_comment"),
        "status",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.try_to_timestamp("created_at").alias("created_at"),
    )


def map_articles(feed: DataFrame) -> DataFrame:
    return feed.select(
        "account_id", *[c for c in ("position",) if c in feed.columns],
        F.col("id").alias("article_id"),
        "title",
        html_to_text(F.col("body")).alias("clean_text"),
        "section_id", "locale",
        F.coalesce("draft", F.lit(False)).alias("draft"),
        F.try_to_timestamp("created_at").alias("created_at"),
        F.try_to_timestamp("updated_at").alias("updated_at"),
    )
