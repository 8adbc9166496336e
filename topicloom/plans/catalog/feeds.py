"""Feeds and ingest: pages, mapping, windows, triage, streams."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.operators import ingest as I
from topicloom.operators.models import hashing_embedder
from topicloom.operators.upsert import latest_per_key as latest
from topicloom.plans.article_run import ArticleRuns
from topicloom.plans.catalog.texts import ORACLES as TEXT_ORACLES
from topicloom.plans.catalog.texts import TABLE_DIMENSION
from topicloom.schemas import ARTICLE_PAGE, TICKET_PAGE
from topicloom.session import work_path
from topicloom.sources import pages as P
from topicloom.sources import tables
from topicloom.sources.chain import stream_chain
from topicloom.streaming.ingest import read_change_log, start_change_log

PAGE_SPAN = 1000
FEED_START = 1704067200

EVENTS_30_AS_OF = datetime(2024, 2, 15)
EVENTS_60_AS_OF = datetime(2024, 3, 20)
ORDERS_90_AS_OF = datetime(2001, 8, 1)


def _ticket_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as feed tickets, with gaps: no subject (de), no tags (es), bad time (fr)."""
    hours = F.lit(FEED_START) + F.col("doc_id") * 3600
    iso = F.date_format(F.timestamp_seconds(hours), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return tables.table(spark, folder, "documents").select(
        F.col("source").alias("account_id"), F.col("doc_id").alias("id"),
        F.when(F.col("lang") != "de", tables.first_line(F.col("text"))).alias("subject"),
        F.col("text").alias("description"), F.lit("open").alias("status"),
        F.when(F.col("lang") != "es", F.array("lang", "source")).alias("tags"),
        F.when(F.col("lang") == "fr", F.lit("not a time")).otherwise(iso).alias("created_at"),
        hours.alias("generated_timestamp"))


def ticket_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Write each tenant's feed as a chain of JSON pages, of which one names the next, and
    follow the chains from the start of the window."""
    record = F.struct("id", "subject", "description", "status", "tags", "created_at",
                      "generated_timestamp")
    feed = _ticket_feed(spark, folder)
    page = F.floor(F.col("id") / PAGE_SPAN)
    pages = feed.groupBy(F.col("account_id").alias("feed"), page.alias("page")).agg(F.collect_list(record).alias("tickets"))
    along = Window.partitionBy("feed").orderBy("page")
    after = F.concat(F.lit("after-"), F.col("page").cast("string"))
    chained = pages.select(
        "feed", F.coalesce(F.lag(after).over(along), F.lit(str(FEED_START))).alias("at"), "tickets",
        F.lead("page").over(along).isNull().alias("end_of_stream"), after.alias("after_cursor"))
    work = work_path(spark, "ticket-pages")
    chained.repartition("feed", "at").write.partitionBy("feed", "at").json(f"{work}/feed")
    tenants = [r["feed"] for r in pages.select("feed").distinct().orderBy("feed").toLocalIterator()]
    stream = stream_chain(spark, f"{work}/stage", "cursor", FEED_START, tenants, TICKET_PAGE, path=f"{work}/feed")
    (P.tickets_of(stream).writeStream.format("parquet").option("path", f"{work}/tickets")
     .option("checkpointLocation", f"{work}/offsets").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{work}/tickets").select(
        "account_id", "id", "subject", F.md5("description").alias("description_md5"),
        F.array_join("tags", "|").alias("tags"), "created_at", "generated_timestamp")


def article_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Write articles as JSON pages, fetch them page by page through the feed source."""
    feed = tables.feed_articles(spark, folder)
    page = F.floor(F.col("id") / PAGE_SPAN).alias("page")
    pages = feed.groupBy("account_id", page).agg(
        F.collect_list(F.struct(*[c for c in feed.columns if c != "account_id"])).alias("articles"),
        F.max(F.unix_seconds(F.to_timestamp("updated_at"))).alias("end_time"))
    path = work_path(spark, "article-pages")
    pages.drop("page").write.json(path)
    spark.dataSource.register(P.PageFeed)
    fetched = spark.read.format("page_feed").option("path", path).load()
    return P.articles_of(P.parsed_pages(fetched, ARTICLE_PAGE)).select(
        "account_id", "id", "title", "locale", "draft", F.md5("body").alias("body_md5"), "updated_at")


def _article_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two listings of the pages as articles of three tenants, with the number of their page.

    The first lacks .org and has .net a day older. The second lists some articles twice:
    every 7th unchanged, every 11th an hour newer.
    """
    feed = tables.feed_articles(spark, folder)
    tenant, page = F.regexp_extract("account_id", r"([^.]+\.[^.]+)$", 1), F.floor(F.col("id") / PAGE_SPAN)
    every = feed.withColumn("account_id", tenant).withColumn("page", page)
    moved = lambda by: F.date_format(F.to_timestamp("updated_at") + F.expr(by), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    older = F.when(F.col("account_id").endswith(".net"), moved("INTERVAL -1 DAY")).otherwise(F.col("updated_at"))
    again = F.lit(1 << 40)
    return (every.where(~F.col("account_id").endswith(".org")).withColumn("updated_at", older),
            every.union(every.where("id % 7 = 0").withColumn("page", again))
            .union(every.where("id % 11 = 0").withColumns({"page": again + 1, "updated_at": moved("INTERVAL 1 HOUR")})))


def article_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over time-paged feeds: the stored articles, how often each was seen, and
    how often a version of it was embedded."""
    work = work_path(spark, "article-ingest")
    tenants: list[str] = []
    for run, listing in enumerate(_article_versions(spark, folder), 1):
        rows = listing.groupBy(F.col("account_id").alias("feed"), "page").agg(
            F.collect_list(F.struct(*[c for c in listing.columns if c not in ("account_id", "page")])).alias("articles"))
        along = Window.partitionBy("feed").orderBy("page")
        at = FEED_START + F.row_number().over(along)
        pages = rows.select("feed", (at - 1).cast("string").alias("at"), "articles", at.alias("end_time"),
                            F.when(F.lead("page").over(along).isNotNull(), F.lit("more")).alias("next_page"))
        pages.repartition("feed", "at").write.partitionBy("feed", "at").json(f"{work}/feed-{run}")
        tenants = [r["feed"] for r in spark.read.json(f"{work}/feed-{run}").select("feed").distinct().toLocalIterator()]
        job = ArticleRuns(spark, f"{work}/store", sorted(tenants), hashing_embedder(TABLE_DIMENSION), TABLE_DIMENSION)
        job.start_feed(run, datetime.fromtimestamp(FEED_START, UTC), lookback_days=0, path=f"{work}/feed-{run}")
    return job.articles().select(
        "account_id", "article_id", "title", "locale", "draft", F.md5("clean_text").alias("text_md5"),
        F.unix_seconds("updated_at").alias("updated_epoch"), "seen", "embedded",
        (F.col("seen") - F.col("embedded")).alias("skipped"), F.coalesce(F.size("embedding"), F.lit(0)).alias("dimensions"))


def page_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of which every third is cut off and some hold a ticket without an id; what
    a run would stop at, counted by reason."""
    number = F.floor(F.col("id") / 10)
    no_id = F.when(F.col("id") % 251 != 7, F.col("id"))
    pages = _ticket_feed(spark, folder).groupBy("account_id", number.alias("page")).agg(
        F.collect_list(F.struct(no_id.alias("id"), "subject")).alias("tickets"))
    text = F.to_json(F.struct("account_id", "tickets"), {"ignoreNullFields": "false"})
    cut = F.when(F.col("page") % 3 == 1, F.substring(text, F.lit(1), F.length(text) - 5)).otherwise(text)
    path = work_path(spark, "broken-pages")
    pages.select(cut.alias("value")).write.text(path)
    rejects = P.page_rejects(P.read_page_files(spark, path, TICKET_PAGE), "tickets")
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("pages"))


def ticket_mapping(spark: SparkSession, folder: str) -> DataFrame:
    mapped = I.map_tickets(_ticket_feed(spark, folder))
    return mapped.select(
        "account_id", "ticket_id", "subject", F.md5("first_comment").alias("first_comment_md5"),
        F.size("tags").alias("tag_count"), I.epoch_seconds(F.col("created_at")).alias("created_epoch"))


def _triage_feed(spark: SparkSession, folder: str) -> DataFrame:
    """One field per user and event type; two types share a title after clean-up."""
    titles = {"click": " Category ", "view": "INTENT", "purchase": "Sentiment\t",
              "signup": "category", "error": "Priority"}
    title = F.col("event_type")
    for event_type, written in titles.items():
        title = F.when(F.col("event_type") == event_type, written).otherwise(title)
    per_type = tables.table(spark, folder, "events").groupBy(
        F.col("user_id").alias("account_id"), "event_type").agg(F.min("event_id").alias("id"))
    return per_type.select("account_id", "id", title.alias("title"), F.col("id").alias("ordinal"))


def triage_field_dim(spark: SparkSession, folder: str) -> DataFrame:
    return I.triage_fields(_triage_feed(spark, folder))


def triage_values(spark: SparkSession, folder: str) -> DataFrame:
    """Events as tickets of their user; errors carry a number where text belongs."""
    events = tables.table(spark, folder, "events", heavy=True)
    fields = I.triage_dimension(_triage_feed(spark, folder))
    kind, number = F.to_json(F.struct("event_type")), F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "error", number).otherwise(
        F.get_json_object(kind, "$.event_type"))
    quoted = F.concat(F.lit('"'), kind, F.lit('"'))
    first = F.parse_json(F.when(F.col("event_type") == "error", kind).otherwise(quoted))
    low = number.cast("int") < 50
    second = F.parse_json(F.when(low, F.concat(F.lit('"k'), number, F.lit('"'))).otherwise("true"))
    rows = events.withColumnRenamed("user_id", "account_id").join(
        fields.withColumnRenamed("category_field", "c").withColumnRenamed("intent_field", "i")
        .withColumnRenamed("sentiment_field", "s")
        .select("account_id", "c", "i", "s"), "account_id", "left")
    mood = F.parse_json(F.when(F.col("value") > 50, F.lit('"pleased"')).otherwise(F.lit("null")))
    rows = rows.select("event_id", "account_id", F.array(
        F.struct(F.col("c").alias("id"), first.alias("value")),
        F.struct(F.col("i").alias("id"), second.alias("value")),
        F.struct(F.col("s").alias("id"), mood.alias("value")),
        F.struct(F.col("c").alias("id"), F.parse_json(F.lit('"later"')).alias("value")),
    ).alias("custom_fields"))
    return I.with_triage(rows, fields).select("event_id", "category", "intent", "sentiment")


def _window(table: str, id_col: str, time_col: str, as_of: datetime, days: int):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = tables.table(spark, folder, table).select(id_col, time_col)
        return I.in_window(rows, time_col, F.lit(as_of).cast("timestamp_ntz"), days).select(id_col)
    return query


def epoch_seconds(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "events").select(
        "event_id", I.epoch_seconds(F.col("ts")).alias("seconds"))


def events_props(spark: SparkSession, folder: str) -> DataFrame:
    """Parse JSON properties and write a JSON detail."""
    events = tables.table(spark, folder, "events").withColumn(
        "k", F.from_json("props", "k int")["k"])
    return events.select("event_id", "k", F.to_json(F.struct("event_type", "k")).alias("detail"))


def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    turns = tables.table(spark, folder, "conversations")
    return latest(turns, ["conv_id"], ["turn"]).select(
        "conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Events applied in three deliveries of a stream that stops and resumes.

    The last delivery repeats the one before it, as a feed may after a failure.
    Per user the kind and value are the last event's, the first id is kept.
    """
    events = tables.table(spark, folder, "events").select(
        "user_id", "event_id", F.col("event_id").alias("first_event"), "event_type", "value")
    third = events.agg(F.max("event_id")).first()[0] // 3
    bounds = [(-1, third), (third, 3 * third + 3), (2 * third, 3 * third + 3)]
    work = work_path(spark, "stream-upsert")
    inbox, log = f"{work}/inbox", f"{work}/log"
    shape = (("user_id",), ("event_id",), ("event_id", "event_type", "value"))
    for low, high in bounds:
        part = events.filter((F.col("event_id") > low) & (F.col("event_id") <= high))
        part.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(events.schema).parquet(inbox)
        start_change_log(stream, log, f"{work}/offsets", *shape).awaitTermination()
    return read_change_log(spark, log, *shape).select(
        "user_id", "event_id", "first_event", "event_type", "value")


QUERIES = {
    "ticket_pages": ticket_pages,
    "article_pages": article_pages,
    "article_ingest": article_ingest,
    "ticket_mapping": ticket_mapping,
    "triage_field_dim": triage_field_dim,
    "triage_values": triage_values,
    "page_rejects": page_rejects,
    "window_filter_30": _window("events", "event_id", "ts", EVENTS_30_AS_OF, 30),
    "window_filter_60": _window("events", "event_id", "ts", EVENTS_60_AS_OF, 60),
    "window_filter_90": _window("orders", "o_orderkey", "o_orderdate", ORDERS_90_AS_OF, 90),
    "epoch_seconds": epoch_seconds,
    "events_props": events_props,
    "latest_per_key": latest_per_key,
    "stream_upsert": stream_upsert,
}

# SQL texts -----------------------------------------------------------------

_ISO = "strftime(to_timestamp({}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"

ORACLES = {
    "ticket_pages": f"""
SELECT source AS account_id, doc_id AS id,
       CASE WHEN lang <> 'de' THEN split_part(text, chr(10), 1) END AS subject,
       md5(text) AS description_md5,
       CASE WHEN lang <> 'es' THEN lang || '|' || source END AS tags,
       CASE WHEN lang = 'fr' THEN 'not a time' ELSE {_ISO.format("1704067200 + doc_id * 3600")} END AS created_at,
       1704067200 + doc_id * 3600 AS generated_timestamp
FROM documents""",
    "article_pages": f"""
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS account_id, page_id AS id,
       regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title,
       regexp_extract(html, '<html lang="([a-z]+)"', 1) AS locale,
       contains(url, '#') AS draft, md5(html) AS body_md5,
       {_ISO.format("1704067200 + page_id * 60")} AS updated_at
FROM pages""",
    "article_ingest": f"""
WITH clean AS ({TEXT_ORACLES["html_to_text"]}),
p AS (SELECT regexp_extract(url, '^https?://(?:[^/]*\\.)?([^./]+\\.[^./]+)(?:/|$)', 1) AS account_id, page_id AS article_id,
        regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS locale,
        contains(url, '#') AS draft, clean_md5 AS text_md5, 1704067200 + page_id * 60 AS version,
        (page_id % 7 = 0)::INT AS twice, (page_id % 11 = 0)::INT AS newer FROM pages JOIN clean USING (page_id)),
q AS (SELECT *, (NOT ends_with(account_id, '.org'))::INT AS before, (NOT ends_with(account_id, '.com'))::INT AS changed FROM p)
SELECT account_id, article_id, title, locale, draft, text_md5, version + 3600 * newer AS updated_epoch,
       (before + 1 + twice + newer)::BIGINT AS seen,
       (CASE WHEN draft THEN 0 ELSE before + changed + newer END)::BIGINT AS embedded, seen - embedded AS skipped,
       CASE WHEN draft THEN 0 ELSE {TABLE_DIMENSION} END::INT AS dimensions
FROM q""",
    "ticket_mapping": """
SELECT source AS account_id, doc_id AS ticket_id,
       CASE WHEN lang <> 'de' THEN split_part(text, chr(10), 1) END AS subject,
       md5(text) AS first_comment_md5, CASE WHEN lang = 'es' THEN 0 ELSE 2 END AS tag_count,
       CASE WHEN lang <> 'fr' THEN 1704067200 + doc_id * 3600 END AS created_epoch
FROM documents""",
    "triage_field_dim": """
WITH f AS (
  SELECT user_id AS account_id, min(event_id) AS id, event_type,
         CASE event_type WHEN 'click' THEN 'category' WHEN 'signup' THEN 'category'
                         WHEN 'view' THEN 'intent' WHEN 'purchase' THEN 'sentiment' END AS title
  FROM events GROUP BY user_id, event_type)
SELECT account_id, title, max(id) AS field_id FROM f WHERE title IS NOT NULL GROUP BY 1, 2""",
    "triage_values": """
WITH f AS (
  SELECT user_id,
         max(id) FILTER (event_type IN ('click', 'signup')) AS c,
         max(id) FILTER (event_type = 'view') AS i,
         max(id) FILTER (event_type = 'purchase') AS s
  FROM (SELECT user_id, event_type, min(event_id) AS id FROM events GROUP BY 1, 2) GROUP BY 1)
SELECT event_id,
       CASE WHEN c IS NOT NULL AND event_type <> 'error' THEN event_type END AS category,
       CASE WHEN i IS NOT NULL AND CAST(props->>'$.k' AS INTEGER) < 50
            THEN 'k' || (props->>'$.k') END AS intent,
       CASE WHEN s IS NOT NULL AND value > 50 THEN 'pleased' END AS sentiment
FROM events LEFT JOIN f USING (user_id)""",
    "page_rejects": """
WITH p AS (SELECT source, doc_id // 10 AS page, bool_or(doc_id % 251 = 7) AS no_id FROM documents GROUP BY 1, 2),
r AS (SELECT CASE WHEN page % 3 = 1 THEN 'a page does not parse'
                  WHEN no_id THEN 'one of tickets has no id' END AS reason FROM p)
SELECT reason, count(*) AS pages FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "window_filter_30": """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY""",
    "window_filter_60": """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-03-20 00:00:00' - INTERVAL 60 DAY""",
    "window_filter_90": """
SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 90 DAY""",
    "epoch_seconds": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events",
    "events_props": """
SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k,
       '{"event_type":"' || event_type || '","k":' || (props->>'$.k') || '}' AS detail
FROM events""",
    "latest_per_key": """
SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
    "stream_upsert": """
SELECT user_id, max(event_id) AS event_id, min(event_id) AS first_event,
       arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
FROM events GROUP BY user_id""",
}
