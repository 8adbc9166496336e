"""One explicit schema per table and feed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

ID = T.LongType()
TEXT = T.StringType()
TIME = T.TimestampType()
VECTOR = T.ArrayType(T.FloatType())

CUSTOM_FIELD = T.StructType([
    T.StructField("id", ID),
    # Untyped in the feed. VARIANT keeps the JSON type, so that a number or a
    # boolean is not mistaken for text.
    T.StructField("value", T.VariantType()),
])

FEED_TICKET = T.StructType([
    T.StructField("id", ID),
    T.StructField("subject", TEXT),
    T.StructField("description", TEXT),
    T.StructField("status", TEXT),
    T.StructField("tags", T.ArrayType(TEXT)),
    T.StructField("created_at", TEXT),
    T.StructField("generated_timestamp", ID),
    T.StructField("custom_fields", T.ArrayType(CUSTOM_FIELD)),
])

TICKET_PAGE = T.StructType([
    T.StructField("account_id", TEXT),
    T.StructField("tickets", T.ArrayType(FEED_TICKET)),
    T.StructField("end_of_stream", T.BooleanType()),
    T.StructField("after_cursor", TEXT),
    T.StructField("_corrupt_record", TEXT),
])

FEED_ARTICLE = T.StructType([
    T.StructField("id", ID),
    T.StructField("title", TEXT),
    T.StructField("body", TEXT),
    T.StructField("locale", TEXT),
    T.StructField("draft", T.BooleanType()),
    T.StructField("section_id", ID),
    T.StructField("created_at", TEXT),
    T.StructField("updated_at", TEXT),
])

ARTICLE_PAGE = T.StructType([
    T.StructField("account_id", TEXT),
    T.StructField("articles", T.ArrayType(FEED_ARTICLE)),
    T.StructField("next_page", TEXT),
    T.StructField("end_time", ID),
    T.StructField("_corrupt_record", TEXT),
])

TICKET_FIELD = T.StructType([
    T.StructField("id", ID),
    T.StructField("type", TEXT),
    T.StructField("title", TEXT),
])

TICKET_FIELD_PAGE = T.StructType([
    T.StructField("account_id", TEXT),
    T.StructField("ticket_fields", T.ArrayType(TICKET_FIELD)),
])

TICKETS = T.StructType([
    T.StructField("account_id", TEXT),
    T.StructField("run_id", ID),
    T.StructField("ticket_id", ID),
    T.StructField("subject", TEXT),
    T.StructField("description", TEXT),
    T.StructField("first_comment", TEXT),
    T.StructField("status", TEXT),
    T.StructField("tags", T.ArrayType(TEXT)),
    T.StructField("created_at", TIME),
    T.StructField("category", TEXT),
    T.StructField("intent", TEXT),
    T.StructField("sentiment", TEXT),
    T.StructField("ingested_at", TIME),
    T.StructField("embedding", VECTOR),
])

ARTICLES = T.StructType([
    T.StructField("account_id", TEXT),
    T.StructField("article_id", ID),
    T.StructField("title", TEXT),
    T.StructField("clean_text", TEXT),
    T.StructField("section_id", ID),
    T.StructField("locale", TEXT),
    T.StructField("draft", T.BooleanType()),
    T.StructField("created_at", TIME),
    T.StructField("updated_at", TIME),
    T.StructField("embedding", VECTOR),
    T.StructField("embedded_at", TIME),
])

CLUSTERS = T.StructType([
    T.StructField("account_id", TEXT),
    T.StructField("run_id", ID),
    T.StructField("cluster_id", ID),
    T.StructField("label", TEXT),
    T.StructField("summary", TEXT),
    T.StructField("ticket_count", ID),
    T.StructField("centroid", T.ArrayType(T.DoubleType())),
    T.StructField("representative_ids", T.ArrayType(ID)),
])

CLUSTER_MEMBERS = T.StructType([
    T.StructField("account_id", TEXT),
    T.StructField("run_id", ID),
    T.StructField("cluster_id", ID),
    T.StructField("ticket_id", ID),
    T.StructField("distance", T.DoubleType()),
])

RUN_LEDGER = T.StructType([
    T.StructField("account_id", TEXT),
    T.StructField("run_id", ID),
    T.StructField("event_seq", ID),
    T.StructField("window_days", T.IntegerType()),
    T.StructField("as_of", TIME),
    T.StructField("status", TEXT),
    T.StructField("cursor", TEXT),
    T.StructField("at", TIME),
])

AUDIT_LOG = T.StructType([
    T.StructField("account_id", TEXT),
    T.StructField("event_type", TEXT),
    T.StructField("detail_json", TEXT),
    T.StructField("created_at", TIME),
])

RUN_STATUSES = ("pending", "running", "completed", "failed")
GAP_CLASSES = ("missing", "weak", "outdated", "good_coverage")
REVIEW_STATUSES = ("pending_review", "approved", "rejected", "published")
