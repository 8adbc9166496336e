"""Article ingest: a time-paged feed into a stored table, vectors for changed versions only.

Each micro-batch appends what it changes: one row for each article it saw, with the last
metadata, the new vector if there is one, and how often the article was seen and
embedded. Nothing stored is rewritten; the table is the log folded by article, and
``compact`` folds it for good. A batch that is repeated writes its own folder anew and
does not look at what it wrote before, so counters and vectors come out once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.text import mask_pii
from topicloom.operators.ingest import ARTICLE_LOOKBACK_DAYS, ARTICLE_UPDATE_COLS, map_articles
from topicloom.operators.ledger import run_event
from topicloom.operators.models import EMBEDDING_DIMENSION, Embed, embed_texts
from topicloom.operators.refresh import EMBEDDED, KEYS, with_action
from topicloom.schemas import ARTICLE_PAGE, ARTICLES
from topicloom.session import drop_path, path_exists, work_path
from topicloom.sources.chain import stream_chain
from topicloom.sources.pages import placed_articles

# One row of the log: an article as of one batch.
ARTICLE_LOG = T.StructType([
    *ARTICLES.fields,
    T.StructField("seen", T.LongType()), T.StructField("embedded", T.LongType()),
    T.StructField("applied_at", T.TimestampType()),
    T.StructField("run", T.LongType()), T.StructField("batch", T.LongType()),
])
ORDER = ("applied_at", "run", "batch")


@dataclass(frozen=True)
class ArticleResult:
    seen: int
    embedded: int

    @property
    def skipped(self) -> int:
        return self.seen - self.embedded


def changes_of(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per incoming article: its last metadata, ``text`` to embed if one of its
    versions differs from the one before, ``seen`` and ``embedded``.

    ``stored``: ``account_id, article_id, updated_at`` before the batch. An article that
    comes several times is compared with its own last appearance.
    """
    known = stored.select(*KEYS, F.col("updated_at").alias("_stored_at"))
    along = Window.partitionBy(*KEYS).orderBy("position")
    rows = incoming.withColumns({
        "_before": F.lag("updated_at").over(along), "_again": F.lag(F.lit(True), 1, False).over(along)}).join(known, KEYS, "left")
    routed = with_action(rows, F.when(F.col("_again"), F.col("_before")).otherwise(F.col("_stored_at")))
    taken = F.when(F.col("action") == EMBEDDED, F.struct("position", "clean_text"))
    return routed.groupBy(*KEYS).agg(
        F.max_by(F.struct(*ARTICLE_UPDATE_COLS), "position").alias("_last"), F.max(taken)["clean_text"].alias("text"),
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("action") == EMBEDDED).alias("embedded"),
    ).select(*KEYS, "_last.*", "text", "seen", "embedded")


def current_articles(log: DataFrame) -> DataFrame:
    """The article table after all changes: last metadata, last vector, sums of the counts."""
    order = F.struct(*ORDER)
    vector = F.when(F.col("embedding").isNotNull(), order)
    return log.groupBy(*KEYS).agg(
        F.max_by(F.struct(*ARTICLE_UPDATE_COLS), order).alias("_last"),
        F.max_by(F.struct("embedding", "embedded_at"), vector).alias("_vector"),
        F.sum("seen").alias("seen"), F.sum("embedded").alias("embedded"),
    ).select(*KEYS, "_last.*", "_vector.*", "seen", "embedded")


class ArticleRuns:
    """Ingest of the articles of some accounts, stored below ``root``."""

    def __init__(self, spark: SparkSession, root: str, accounts: Sequence[str], build: Callable[[], Embed],
                 dimension: int = EMBEDDING_DIMENSION):
        self.spark, self.root, self.accounts = spark, root.rstrip("/"), list(accounts)
        self.build, self.dimension = build, dimension

    @property
    def log(self) -> DataFrame:
        path = f"{self.root}/articles"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], ARTICLE_LOG)
        return self.spark.read.schema(ARTICLE_LOG).parquet(path)

    def articles(self) -> DataFrame:
        """Columns of ``ARTICLES``, and how often each article was seen and embedded."""
        return current_articles(self.log)

    def start_feed(self, run_id: int, as_of: datetime, lookback_days: int = ARTICLE_LOOKBACK_DAYS,
                   **transport: str) -> ArticleResult:
        """All articles updated since the look-back; call it again after a failure.

        ``transport``: options of ``page_chain`` that say how a page is fetched.
        """
        start = as_of.replace(tzinfo=as_of.tzinfo or UTC) - timedelta(days=lookback_days)
        pages = stream_chain(self.spark, f"{self.root}/article_stage/run={run_id}", "time", int(start.timestamp()),
                             self.accounts, ARTICLE_PAGE, **transport)
        self._record(run_id, lookback_days, as_of, "running")
        try:
            while self._drive(pages, run_id, as_of):
                pass
        except Exception:
            self._record(run_id, lookback_days, as_of, "failed")
            raise
        self._record(run_id, lookback_days, as_of, "completed")
        return self.result(run_id)

    def result(self, run_id: int) -> ArticleResult:
        counts = self.log.where(F.col("run") == run_id).agg(F.sum("seen"), F.sum("embedded")).first()
        return ArticleResult(counts[0] or 0, counts[1] or 0)

    def _drive(self, pages: DataFrame, run_id: int, at: datetime) -> bool:
        """Apply the pages there are; whether there were any."""

        def apply(batch: DataFrame, batch_id: int) -> None:
            own = placed_articles(batch).where(F.col("account_id").isin(self.accounts))
            before = self.log.where((F.col("run") != run_id) | (F.col("batch") < batch_id))
            stored = before.groupBy(*KEYS).agg(F.max_by("updated_at", F.struct(*ORDER)).alias("updated_at"))
            # Cleaned once: embedding reads the rows that have a text, the log all of them.
            work = work_path(self.spark, "articles")
            changes_of(map_articles(own), stored).write.parquet(work)
            changes = self.spark.read.parquet(work)
            todo = changes.where("text is not null").withColumn("text", mask_pii(F.col("text")))
            fresh = embed_texts(todo, "text", self.build, self.dimension).withColumn("embedded_at", F.lit(at))
            others = changes.where("text is null").drop("text").withColumns(
                {"embedding": F.lit(None).cast("array<float>"), "embedded_at": F.lit(None).cast("timestamp")})
            rows = fresh.unionByName(others).withColumn("applied_at", F.current_timestamp())
            columns = [c for c in ARTICLE_LOG.names if c not in ("run", "batch")]
            rows.select(*columns).write.mode("overwrite").parquet(f"{self.root}/articles/run={run_id}/batch={batch_id}")
            drop_path(self.spark, work)

        query = (pages.writeStream.foreachBatch(apply)
                 .option("checkpointLocation", f"{self.root}/article_offsets/run={run_id}")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return query.lastProgress is not None and query.lastProgress["numInputRows"] > 0

    def _record(self, run_id: int, days: int, as_of: datetime, status: str) -> None:
        now, place = datetime.now(UTC), time.time_ns() // 1000
        rows = [run_event(self.spark, a, run_id, place, status, now, days, as_of) for a in self.accounts]
        reduce(DataFrame.union, rows).write.mode("append").parquet(f"{self.root}/article_ledger")


def compact_articles(spark: SparkSession, root: str, target: str) -> None:
    """The log below ``root`` folded into one batch of a new log below ``target``, which
    readers and the next run then take; counts of runs before that are kept as sums."""
    log = spark.read.schema(ARTICLE_LOG).parquet(f"{root}/articles")
    last = log.groupBy(*KEYS).agg(F.max("applied_at").alias("applied_at"))
    columns = [c for c in ARTICLE_LOG.names if c not in ("run", "batch")]
    (current_articles(log).join(last, KEYS).select(*columns)
     .write.parquet(f"{target}/articles/run=-1/batch=0"))
