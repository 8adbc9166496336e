"""Reports over clusters: excerpts, labels, keywords, coverage gaps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.text import label_prompt
from topicloom.operators import gaps as G
from topicloom.operators import labels as L
from topicloom.operators.nearest import nearest
from topicloom.plans.catalog.clusters import _BY_LABEL, _CENTERS
from topicloom.plans.catalog.texts import SQL_TICKETS, sql_masked
from topicloom.plans.catalog.vectors import r6
from topicloom.plans.runs import CLUSTER, centroids, cluster_list, cluster_runs, masked_ticket_text
from topicloom.scope import published_and_embedded
from topicloom.sources import tables

MISSING_BEYOND, WEAK_BEYOND = 0.7, 0.5
OUTDATED_BEFORE = datetime(2024, 1, 1, 4, 10)


def cluster_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    leaders = tables.leaders(spark, folder)
    kept = leaders.members.join(centroids(leaders).select(*CLUSTER), CLUSTER, "left_semi")
    texts = tables.vector_tickets(spark, folder).select(
        "account_id", "ticket_id", "subject", "description")
    masked = L.excerpts(L.representatives(kept), texts)
    prompt = label_prompt(F.col("masked_excerpts"))
    return masked.select(
        "account_id", "cluster_id", F.md5("masked_excerpts").alias("excerpts_md5"),
        F.length("masked_excerpts").alias("excerpts_chars"),
        F.contains(prompt, F.col("masked_excerpts")).alias("in_prompt"))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    leaders = tables.leaders(spark, folder)
    kept_clusters = centroids(leaders).select(*CLUSTER)
    kept = leaders.members.join(kept_clusters, CLUSTER, "left_semi")
    texts = masked_ticket_text(tables.vector_tickets(spark, folder, heavy=True))
    joined = kept.join(texts.select("account_id", "ticket_id", "text"), ["account_id", "ticket_id"])
    return L.term_scores(joined, kept_clusters)


def cluster_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return L.keywords(_scores(spark, folder)).select(
        "account_id", "cluster_id", "rank", "term", "tf", "df", "score")


def cluster_labels(spark: SparkSession, folder: str) -> DataFrame:
    return L.extractive_labels(_scores(spark, folder)).select("account_id", "cluster_id", "label")


def cluster_report(spark: SparkSession, folder: str) -> DataFrame:
    """The whole clustering job, then its list of topics by size."""
    run = cluster_runs(tables.vector_tickets(spark, folder), tables.TABLE_THRESHOLD)
    return cluster_list(run.clusters).select(
        "account_id", "cluster_id", "label", "summary", "ticket_count",
        F.array_join("representative_ids", ",").alias("representative_ids"))


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters with the nearest published article of any tenant's knowledge base."""
    centers = centroids(tables.leaders(spark, folder))
    articles = published_and_embedded(tables.vector_articles(spark, folder))
    found = nearest(centers, articles, 1, ["account_id"], "cluster_id", "centroid",
                    "article_id", "embedding")
    best = found.select("account_id", F.col("query_id").alias("cluster_id"),
                        F.col("item_id").alias("article_id"), "distance")
    ages = articles.select("account_id", "article_id", "updated_at")
    topics = (centers.drop("centroid").join(best, ["account_id", "cluster_id"], "left")
              .join(ages, ["account_id", "article_id"], "left"))
    return G.classify_gaps(topics, MISSING_BEYOND, WEAK_BEYOND, OUTDATED_BEFORE)


def gap_classification(spark: SparkSession, folder: str) -> DataFrame:
    return _gaps(spark, folder).select("account_id", "cluster_id", "ticket_count", "article_id",
                                       r6(F.col("distance")).alias("distance"), "classification")


def gap_volume(spark: SparkSession, folder: str) -> DataFrame:
    return G.gap_volume(_gaps(spark, folder)).select(
        "account_id", "classification", "topics", "ticket_volume")


def gap_priority(spark: SparkSession, folder: str) -> DataFrame:
    return G.prioritize(_gaps(spark, folder)).select(
        "account_id", "cluster_id", r6(F.col("priority_score")).alias("priority_score"),
        r6(F.col("priority_rank")).alias("priority_rank"))


def gap_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    return G.dashboard_lists(_gaps(spark, folder), 5).select(
        "account_id", "list", "position", "cluster_id", "ticket_count")


def review_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as drafts in review."""
    status = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "published")
              .when(F.col("quality") == 1, "pending_review")
              .when(F.col("toxic") == 0, "rejected").otherwise("approved"))
    drafts = tables.table(spark, folder, "labels").select("doc_id", status.alias("review_status"))
    tenants = tables.table(spark, folder, "documents").select("doc_id", F.col("source").alias("account_id"))
    return G.review_funnel(drafts.join(tenants, "doc_id"))


QUERIES = {
    "cluster_excerpt": cluster_excerpt,
    "cluster_keywords": cluster_keywords,
    "cluster_labels": cluster_labels,
    "cluster_report": cluster_report,
    "gap_classification": gap_classification,
    "gap_volume": gap_volume,
    "gap_priority": gap_priority,
    "gap_dashboard": gap_dashboard,
    "review_funnel": review_funnel,
}

# SQL texts -----------------------------------------------------------------

_TEXTS = f""",
t AS ({SQL_TICKETS}),
kept AS (SELECT g, id, cluster_id, n, row_number() OVER (PARTITION BY g, cluster_id ORDER BY id) AS r
         FROM member WHERE n >= 2)"""

_SCORES = _TEXTS + f""",
raw AS (SELECT k.g, k.cluster_id,
               concat_ws(chr(10) || chr(10), nullif(subject, ''), nullif(description, '')) AS raw
        FROM kept k JOIN t ON t.ticket_id = k.id),
word AS (SELECT g, cluster_id,
                unnest(regexp_extract_all(lower({sql_masked("raw")}), '[\\p{{L}}\\p{{N}}]+')) AS term
         FROM raw WHERE regexp_matches(raw, '[^\\s\\x{{00A0}}]')),
tf AS (SELECT g, cluster_id, term, count(*) AS tf FROM word GROUP BY 1, 2, 3),
df AS (SELECT g, term, count(*) AS df FROM tf GROUP BY 1, 2),
total AS (SELECT g, count(DISTINCT cluster_id) AS n FROM kept GROUP BY 1),
score AS (SELECT g, cluster_id, term, tf, df, round(tf * (ln((n + 1) / (df + 1)) + 1), 6) AS score
          FROM tf JOIN df USING (g, term) JOIN total USING (g)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g, cluster_id ORDER BY score DESC, term) AS rank FROM score)"""

_LABELS = """,
label AS (SELECT g, cluster_id, string_agg(term, ' ' ORDER BY rank) AS label FROM ranked
          WHERE rank <= 3 GROUP BY 1, 2)"""

_GAPS = _BY_LABEL + _CENTERS + f""",
article AS (SELECT CAST(label AS VARCHAR) AS g, page_id, CAST(embedding AS DOUBLE[]) AS a,
                   1704067200 + page_id * 60 AS updated
            FROM pages JOIN embeddings ON vec_id = page_id WHERE NOT contains(url, '#')),
pair AS (SELECT c.g, c.cluster_id, c.n, page_id, updated,
                1 - list_cosine_similarity(c.c, a) AS distance
         FROM center c LEFT JOIN article USING (g) WHERE c.n >= 2),
best AS (SELECT * FROM pair QUALIFY row_number() OVER (
           PARTITION BY g, cluster_id ORDER BY round(distance, 9), page_id) = 1),
gap AS (SELECT g, cluster_id, n, page_id, distance,
               CASE WHEN distance IS NULL OR distance > {MISSING_BEYOND} THEN 'missing'
                    WHEN distance > {WEAK_BEYOND} THEN 'weak'
                    WHEN updated < epoch(TIMESTAMP '2024-01-01 04:10:00') THEN 'outdated'
                    ELSE 'good_coverage' END AS class FROM best)"""

ORACLES = {
    "cluster_excerpt": _BY_LABEL + _TEXTS + f""",
found AS (SELECT k.*, t.subject, t.description,
                 row_number() OVER (PARTITION BY k.g, k.cluster_id ORDER BY k.id) AS i
          FROM kept k LEFT JOIN t ON t.ticket_id = k.id WHERE k.r <= 5),
joined AS (SELECT g, cluster_id, string_agg(
    'Ticket ' || i || ':' || chr(10) || 'Subject: ' || coalesce(subject, '(none)') || chr(10)
    || 'Description: ' || coalesce(description, '(none)'), chr(10) || chr(10) ORDER BY i) AS raw
  FROM found GROUP BY 1, 2),
masked AS (SELECT g, cluster_id, {sql_masked("raw")} AS m FROM joined)
SELECT g AS account_id, cluster_id, md5(m) AS excerpts_md5, CAST(length(m) AS INTEGER) AS excerpts_chars,
       true AS in_prompt FROM masked""",
    "cluster_keywords": _BY_LABEL + _SCORES + """
SELECT g AS account_id, cluster_id, CAST(rank AS INTEGER) AS rank, term, tf, df, score
FROM ranked WHERE rank <= 5""",
    "cluster_labels": _BY_LABEL + _SCORES + _LABELS + """
SELECT g AS account_id, cluster_id, label FROM label""",
    "cluster_report": _BY_LABEL + _SCORES + _LABELS + """,
rep AS (SELECT g, cluster_id, max(n) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)
          FILTER (r <= 5) AS ids FROM kept GROUP BY 1, 2)
SELECT g AS account_id, cluster_id, coalesce(label, 'Unlabeled topic') AS label,
       CASE WHEN label IS NULL THEN '' ELSE n || ' tickets about ' || label END AS summary,
       n AS ticket_count, ids AS representative_ids
FROM rep LEFT JOIN label USING (g, cluster_id) ORDER BY n DESC, cluster_id""",
    "gap_classification": _GAPS + """
SELECT g AS account_id, cluster_id, n AS ticket_count, page_id AS article_id,
       round(distance, 6) + 0.0 AS distance, class AS classification FROM gap""",
    "gap_volume": _GAPS + """
SELECT g AS account_id, class AS classification, count(*) AS topics,
       CAST(sum(n) AS BIGINT) AS ticket_volume FROM gap GROUP BY 1, 2""",
    "gap_priority": _GAPS + """,
scored AS (SELECT g, cluster_id, n * CASE class WHEN 'missing' THEN 1.0::DOUBLE WHEN 'outdated' THEN 0.7::DOUBLE
                                    WHEN 'weak' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS s FROM gap)
SELECT g AS account_id, cluster_id, round(s, 6) + 0.0 AS priority_score,
       round(percent_rank() OVER (PARTITION BY g ORDER BY s), 6) + 0.0 AS priority_rank FROM scored""",
    "gap_dashboard": _GAPS + """,
listed AS (
  SELECT g, cluster_id, n, 'most_repeated' AS list FROM gap
  UNION ALL SELECT g, cluster_id, n, 'top_missing' FROM gap WHERE class = 'missing'
  UNION ALL SELECT g, cluster_id, n, 'needs_update' FROM gap WHERE class IN ('weak', 'outdated')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g, list ORDER BY n DESC, cluster_id) AS p FROM listed)
SELECT g AS account_id, list, CAST(p AS INTEGER) AS position, cluster_id, n AS ticket_count
FROM ranked WHERE p <= 5""",
    "review_funnel": """
SELECT source AS account_id,
       count(*) FILTER (quality = 1 AND toxic = 1) AS pending_review,
       count(*) FILTER (quality = 0 AND toxic = 1) AS approved,
       count(*) FILTER (quality = 0 AND toxic = 0) AS rejected,
       count(*) FILTER (quality = 1 AND toxic = 0) AS published
FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
}
