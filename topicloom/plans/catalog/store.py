"""Stored tables: scoped reads, upserts, refresh, run replacement, ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.ingest import ARTICLE_UPDATE_COLS, map_articles
from topicloom.operators.ledger import failure_audit, latest_runs
from topicloom.operators.refresh import refresh_counts, route_articles
from topicloom.operators.upsert import latest_per_key, replace_runs, upsert
from topicloom.plans.catalog.texts import ORACLES as TEXT_ORACLES
from topicloom.plans.catalog.texts import SQL_TICKETS
from topicloom.plans.runs import embed_counts
from topicloom.scope import by_ids, embedded, needing_embedding
from topicloom.sources import tables


def tickets_needing_embedding(spark: SparkSession, folder: str) -> DataFrame:
    return needing_embedding(tables.tickets(spark, folder)).select("account_id", "run_id", "ticket_id")


def embedded_tickets(spark: SparkSession, folder: str) -> DataFrame:
    return embedded(tables.tickets(spark, folder)).select(
        "account_id", "run_id", "ticket_id", F.size("embedding").alias("dimensions"))


def tickets_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    wanted = tables.table(spark, folder, "labels").filter(F.col("toxic") == 1).select(
        F.col("doc_id").alias("ticket_id"))
    return by_ids(tables.ticket_texts(spark, folder), wanted).select(
        "ticket_id", "subject", F.md5("description").alias("description_md5"))


def ticket_count(spark: SparkSession, folder: str) -> DataFrame:
    return tables.ticket_texts(spark, folder).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("tickets"))


def article_count(spark: SparkSession, folder: str) -> DataFrame:
    return tables.feed_articles(spark, folder).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("articles"))


def ticket_embed_counts(spark: SparkSession, folder: str) -> DataFrame:
    return embed_counts(tables.tickets(spark, folder))


def tenant_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Tenants are the distinct hosts; every page looks its own up."""
    pages = tables.table(spark, folder, "pages").select(
        "page_id", tables.host(F.col("url")).alias("subdomain"))
    tenants = pages.groupBy("subdomain").agg(F.min("page_id").alias("tenant_id"))
    return pages.join(tenants, "subdomain").select("page_id", "subdomain", "tenant_id")


def ticket_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Last turns merged into opening turns; one-turn talks are new.

    Known talks take role and text of their last turn and keep the opening turn.
    """
    turns = tables.table(spark, folder, "conversations")
    rows = turns.select("conv_id", F.col("turn").alias("created_turn"), "turn", "role",
                        F.md5("text").alias("text_md5"))
    followed = turns.filter(F.col("turn") > 1).select("conv_id").distinct()
    stored = rows.filter(F.col("turn") == 0).join(followed, "conv_id", "left_semi")
    incoming = latest_per_key(rows, ["conv_id"], ["turn"])
    return upsert(stored, incoming, ["conv_id"], ["turn", "role", "text_md5"]).select(
        "conv_id", "created_turn", "turn", "role", "text_md5")


def article_upsert(spark: SparkSession, folder: str) -> DataFrame:
    stored = tables.stored_articles(spark, folder)
    incoming = map_articles(tables.feed_articles(spark, folder, heavy=True))
    merged = upsert(stored, incoming, ["account_id", "article_id"], ARTICLE_UPDATE_COLS)
    return merged.select("account_id", "article_id", "title", "locale", "draft",
                         F.md5("clean_text").alias("text_md5"), F.unix_seconds("updated_at").alias("updated_epoch"))


def embedding_update(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors merged into stored articles; vectors of unknown articles are ignored."""
    stored = tables.stored_articles(spark, folder)
    owners = tables.feed_articles(spark, folder).select("account_id", F.col("id").alias("article_id"))
    vectors = tables.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("article_id"), "embedding",
        F.timestamp_seconds(F.lit(1735689600)).alias("embedded_at")).join(owners, "article_id")
    merged = upsert(stored, vectors, ["account_id", "article_id"], ["embedding", "embedded_at"], insert=False)
    return merged.select(
        "account_id", "article_id", F.coalesce(F.size("embedding"), F.lit(0)).alias("dimensions"),
        F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first_value"),
        F.unix_seconds("embedded_at").alias("embedded_epoch"), "title")


def article_refresh(spark: SparkSession, folder: str) -> DataFrame:
    routed = route_articles(map_articles(tables.feed_articles(spark, folder, heavy=True)),
                            tables.stored_articles(spark, folder))
    return routed.select("account_id", "article_id", "action", "reason")


def article_refresh_counts(spark: SparkSession, folder: str) -> DataFrame:
    routed = route_articles(map_articles(tables.feed_articles(spark, folder, heavy=True)),
                            tables.stored_articles(spark, folder))
    return refresh_counts(routed)


def replace_run(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with a flagged document are replaced by their flagged documents."""
    stored = tables.ticket_texts(spark, folder).select(
        "account_id", "run_id", "ticket_id", F.lit("before").alias("version"))
    flagged = tables.table(spark, folder, "labels").filter(F.col("toxic") == 1).select(
        F.col("doc_id").alias("ticket_id"))
    fresh = by_ids(stored, flagged).withColumn("version", F.lit("after")).select(*stored.columns)
    return replace_runs(stored, fresh)


def run_ledger_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Events as ledger rows of one run per user and day."""
    status = (F.when(F.col("event_type") == "purchase", "completed")
              .when(F.col("event_type") == "error", "failed").otherwise("running"))
    ledger = tables.table(spark, folder, "events").select(
        F.col("user_id").alias("account_id"), F.dayofmonth("ts").alias("run_id"),
        F.col("event_id").alias("event_seq"), F.lit(30).alias("window_days"), status.alias("status"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("c"), F.col("event_id"))).alias("cursor"),
        F.col("ts").alias("at"))
    return latest_runs(ledger).select(
        "account_id", "run_id", "window_days", "status", "cursor",
        F.unix_seconds(F.col("started_at").cast("timestamp")).alias("started_epoch"),
        F.unix_seconds(F.col("completed_at").cast("timestamp")).alias("completed_epoch"))


def audit_failures(spark: SparkSession, folder: str) -> DataFrame:
    """A user's day is a cluster; an error on that day is its failed step."""
    failed = F.col("event_type") == "error"
    clusters = tables.table(spark, folder, "events").groupBy(
        F.col("user_id").alias("account_id"), F.dayofmonth("ts").alias("run_id")).agg(
        F.count(F.lit(1)).alias("ticket_count"),
        F.min(F.when(failed, F.concat(F.lit("event "), F.col("event_id").cast("string")))).alias("error"))
    return failure_audit(clusters, F.lit(None).cast("timestamp")).select(
        "account_id", "event_type", "detail_json")


QUERIES = {
    "tickets_needing_embedding": tickets_needing_embedding,
    "embedded_tickets": embedded_tickets,
    "tickets_by_ids": tickets_by_ids,
    "ticket_count": ticket_count,
    "article_count": article_count,
    "ticket_embed_counts": ticket_embed_counts,
    "tenant_lookup": tenant_lookup,
    "ticket_upsert": ticket_upsert,
    "article_upsert": article_upsert,
    "embedding_update": embedding_update,
    "article_refresh": article_refresh,
    "article_refresh_counts": article_refresh_counts,
    "replace_run": replace_run,
    "run_ledger_latest": run_ledger_latest,
    "audit_failures": audit_failures,
}

# SQL texts -----------------------------------------------------------------

# No page is blank, so only draft and version decide.
_ROUTED = """
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS account_id, page_id AS article_id,
       CASE WHEN contains(url, '#') THEN 'draft'
            WHEN regexp_matches(url, '^https?://[^/]+\\.com(/|$)') THEN 'unchanged'
            WHEN regexp_matches(url, '^https?://[^/]+\\.org(/|$)') THEN 'new'
            ELSE 'changed' END AS reason
FROM pages"""

ORACLES = {
    "tickets_needing_embedding": """
SELECT source AS account_id, lang AS run_id, doc_id AS ticket_id
FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE embedding IS NULL""",
    "embedded_tickets": """
SELECT source AS account_id, lang AS run_id, doc_id AS ticket_id,
       CAST(len(embedding) AS INTEGER) AS dimensions
FROM documents JOIN embeddings ON vec_id = doc_id ORDER BY doc_id""",
    "tickets_by_ids": f"""
WITH t AS ({SQL_TICKETS})
SELECT ticket_id, subject, md5(description) AS description_md5
FROM t WHERE ticket_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "ticket_count": "SELECT source AS account_id, count(*) AS tickets FROM documents GROUP BY source",
    "article_count": """
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS account_id, count(*) AS articles
FROM pages GROUP BY 1""",
    "ticket_embed_counts": """
SELECT source AS account_id, lang AS run_id,
       count(*) FILTER (regexp_matches(text, '\\S')) AS embedded,
       count(*) FILTER (NOT regexp_matches(text, '\\S')) AS skipped
FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE embedding IS NULL GROUP BY 1, 2""",
    "tenant_lookup": """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS subdomain FROM pages)
SELECT page_id, subdomain, min(page_id) OVER (PARTITION BY subdomain) AS tenant_id FROM p""",
    "ticket_upsert": """
WITH s AS (SELECT conv_id FROM conversations c WHERE turn = 0
           AND EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn > 1)),
l AS (SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
SELECT conv_id, CASE WHEN s.conv_id IS NULL THEN turn ELSE 0 END AS created_turn, turn, role, text_md5
FROM l LEFT JOIN s USING (conv_id)""",
    "article_upsert": f"""
WITH clean AS ({TEXT_ORACLES["html_to_text"]})
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS account_id, page_id AS article_id,
       regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title,
       regexp_extract(html, '<html lang="([a-z]+)"', 1) AS locale,
       contains(url, '#') AS draft, clean_md5 AS text_md5, 1704067200 + page_id * 60 AS updated_epoch
FROM pages JOIN clean USING (page_id)""",
    "embedding_update": """
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS account_id, page_id AS article_id,
       CAST(coalesce(len(embedding), 0) AS INTEGER) AS dimensions,
       round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
       CAST(CASE WHEN embedding IS NOT NULL THEN 1735689600 END AS BIGINT) AS embedded_epoch,
       'old title' AS title
FROM pages LEFT JOIN embeddings ON vec_id = page_id
WHERE NOT regexp_matches(url, '^https?://[^/]+\\.org(/|$)')""",
    "article_refresh": f"""
WITH r AS ({_ROUTED})
SELECT account_id, article_id,
       CASE WHEN reason IN ('new', 'changed') THEN 'embedded' ELSE 'skipped' END AS action, reason
FROM r""",
    "article_refresh_counts": f"""
WITH r AS ({_ROUTED})
SELECT account_id, count(*) AS seen, count(*) FILTER (reason IN ('new', 'changed')) AS embedded,
       count(*) FILTER (reason NOT IN ('new', 'changed')) AS skipped
FROM r GROUP BY account_id""",
    "replace_run": """
WITH d AS (SELECT source AS account_id, lang AS run_id, doc_id AS ticket_id,
                  doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS flagged FROM documents),
r AS (SELECT *, bool_or(flagged) OVER (PARTITION BY account_id, run_id) AS replaced FROM d)
SELECT account_id, run_id, ticket_id, CASE WHEN replaced THEN 'after' ELSE 'before' END AS version
FROM r WHERE flagged OR NOT replaced""",
    "run_ledger_latest": """
SELECT user_id AS account_id, CAST(day(ts) AS INTEGER) AS run_id, 30 AS window_days,
       arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
                               ELSE 'running' END, event_id) AS status,
       arg_max('c' || event_id, event_id) FILTER (event_type = 'click') AS cursor,
       CAST(floor(epoch(min(ts))) AS BIGINT) AS started_epoch,
       CAST(floor(epoch(max(ts) FILTER (event_type = 'purchase'))) AS BIGINT) AS completed_epoch
FROM events GROUP BY 1, 2""",
    "audit_failures": """
WITH c AS (SELECT user_id AS account_id, day(ts) AS run_id, count(*) AS n,
                  min('event ' || event_id) FILTER (event_type = 'error') AS error
           FROM events GROUP BY 1, 2)
SELECT account_id, 'clustering_cluster_processing_failed' AS event_type,
       '{"analysisRunId":' || run_id || ',"ticketCount":' || n || ',"error":"' || error || '"}' AS detail_json
FROM c WHERE error IS NOT NULL""",
}
