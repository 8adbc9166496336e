"""The given tables in the roles of tickets, articles, feeds and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.leader import LeaderPass, leader_pass

# Vectors of the given tables are close to unstructured; at 0.70 no two of them
# are alike, at 0.30 they form groups.
TABLE_THRESHOLD = 0.30


def table(spark: SparkSession, folder: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; ``heavy`` if costly work per row follows."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return _spread(df) if heavy else df


def _spread(scan: DataFrame) -> DataFrame:
    """Enough partitions for all cores.

    A file with one row group is one task however many cores there are. A table
    of many files has partitions enough and is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def other_lines(text: Column) -> Column:
    """Text after the first line break; null if there is none."""
    at = F.instr(text, "\n")
    return F.when(at > 0, F.substring(text, at + 1, F.length(text)))


def ticket_texts(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """Documents as tickets: tenant = source, run = language."""
    text = F.col("text")
    return table(spark, folder, "documents", heavy).select(
        F.col("source").alias("account_id"), F.col("lang").alias("run_id"),
        F.col("doc_id").alias("ticket_id"),
        first_line(text).alias("subject"), other_lines(text).alias("description"))


def tickets(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """Tickets with the vector stored for their id, if there is one."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("ticket_id"), "embedding")
    return ticket_texts(spark, folder, heavy).join(vectors, "ticket_id", "left")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Ticket vectors: tenant = label, one run."""
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("account_id"), F.lit(1).cast("long").alias("run_id"),
        F.col("vec_id").alias("ticket_id"), "embedding")


def vector_tickets(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """The same with the texts of the document of that id."""
    text = F.col("text")
    texts = table(spark, folder, "documents", heavy).select(
        F.col("doc_id").alias("ticket_id"),
        first_line(text).alias("subject"), other_lines(text).alias("description"))
    return vectors(spark, folder).join(texts, "ticket_id", "left")


def leaders(spark: SparkSession, folder: str) -> LeaderPass:
    """Clustered once; several views of the result are usually read."""
    return leader_pass(vectors(spark, folder), TABLE_THRESHOLD).saved()


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/]+)", 1)


def page_time(page_id: Column) -> Column:
    """Version of a page: one minute per id from the start of 2024."""
    return F.timestamp_seconds(F.lit(1704067200) + page_id * 60)


def is_draft(url: Column) -> Column:
    return F.contains(url, F.lit("#"))


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, "<h1>([^<]*)</h1>", 1)


def feed_articles(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """Pages as feed articles: tenant = host."""
    url, page_id = F.col("url"), F.col("page_id")
    return table(spark, folder, "pages", heavy).select(
        host(url).alias("account_id"), page_id.alias("id"),
        title_of(F.col("html")).alias("title"), F.col("html").alias("body"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("locale"),
        is_draft(url).alias("draft"), F.lit(None).cast("long").alias("section_id"),
        F.date_format(page_time(page_id), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.date_format(page_time(page_id), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"))


def stored_articles(spark: SparkSession, folder: str) -> DataFrame:
    """What an earlier refresh left: no .org host, .net hosts one day behind."""
    page_id, name = F.col("page_id"), host(F.col("url"))
    at = page_time(page_id)
    older = at - F.make_dt_interval(F.lit(1))
    return table(spark, folder, "pages").filter(~name.endswith(".org")).select(
        name.alias("account_id"), page_id.alias("article_id"),
        F.lit("old title").alias("title"), F.lit("old text").alias("clean_text"),
        F.lit(None).cast("long").alias("section_id"), F.lit("xx").alias("locale"),
        F.lit(False).alias("draft"), at.alias("created_at"),
        F.when(name.endswith(".net"), older).otherwise(at).alias("updated_at"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(None).cast("timestamp").alias("embedded_at"))


def vector_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the vector of their id: tenant = label of that vector."""
    stored = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("page_id"), F.col("label").cast("string").alias("account_id"),
        "embedding")
    pages = table(spark, folder, "pages").select(
        "page_id", is_draft(F.col("url")).alias("draft"), title_of(F.col("html")).alias("title"),
        page_time(F.col("page_id")).alias("updated_at"))
    return pages.join(stored, "page_id").withColumnRenamed("page_id", "article_id")
