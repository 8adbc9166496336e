"""Ticket stream: feed pages to an append-only change log, read back as a table.

Each micro-batch leaves one folder named after its batch id. Replaying a batch
rewrites its own folder, so delivery at least once still gives every row once.
Nothing stored is rewritten per batch; the log is folded when read, and
``compact`` folds it for good.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicloom.operators.ingest import (
    TICKET_UPDATE_COLS,
    check_window,
    in_window,
    map_tickets,
    with_triage,
)
from topicloom.operators.upsert import fold_changes
from topicloom.session import child_names, path_exists
from topicloom.sources.pages import tickets_of

TICKET_KEYS = ("account_id", "ticket_id")
TICKET_ORDER = ("generated_timestamp", "position")
LOGGED_COLS = (*TICKET_UPDATE_COLS, *TICKET_ORDER)


def start_change_log(changes: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...],
                     order: tuple[str, ...], update_cols: tuple[str, ...]) -> StreamingQuery:
    """Write each batch's net change per key; ends once all available input is in."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        net = fold_changes(batch, keys, order, update_cols)
        net.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (changes.writeStream.foreachBatch(apply)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_change_log(spark: SparkSession, path: str, keys: tuple[str, ...],
                    order: tuple[str, ...], update_cols: tuple[str, ...]) -> DataFrame:
    """Current row of every key: later batches win over earlier ones."""
    log = spark.read.parquet(path)
    return fold_changes(log, keys, ("batch", *order), ("batch", *update_cols)).drop("batch")


def compact(spark: SparkSession, path: str, target: str, keys: tuple[str, ...],
            order: tuple[str, ...], update_cols: tuple[str, ...]) -> None:
    """Fold the log into one batch of a new log; readers then move to ``target``."""
    newest = max(int(n.split("=")[1]) for n in child_names(spark, path) if n.startswith("batch="))
    read_change_log(spark, path, keys, order, update_cols).write.parquet(f"{target}/batch={newest}")


def ingest_tickets(pages: DataFrame, path: str, checkpoint: str, run_id: int, window_days: int,
                   as_of: datetime, triage: DataFrame | None = None, account_id: str | None = None,
                   on_undated: Callable[[int], None] | None = None) -> StreamingQuery:
    """Apply a page stream to the ticket log at ``path``.

    A restart on the same checkpoint resumes after the last page fully applied; a page
    that cannot be read fails its batch. ``as_of`` belongs to the run, so a resumed run
    keeps its window. Tickets of other accounts than ``account_id`` are left out, and
    ``on_undated`` is told how many of a batch had a time that does not parse.
    """
    check_window(window_days)

    def apply(batch: DataFrame, batch_id: int) -> None:
        feed = tickets_of(batch)
        if account_id is not None:
            feed = feed.filter(F.col("account_id") == account_id)
        undated = Observation()
        broken_time = F.col("created_at").isNotNull() & F.try_to_timestamp("created_at").isNull()
        feed = feed.observe(undated, F.count_if(broken_time).alias("undated"))
        if triage is not None:
            feed = with_triage(feed, triage)
        else:
            for name in ("category", "intent", "sentiment"):
                feed = feed.withColumn(name, F.lit(None).cast("string"))
        rows = map_tickets(feed.withColumn("run_id", F.lit(run_id).cast("long")))
        rows = in_window(rows, "created_at", as_of, window_days).withColumn(
            "ingested_at", F.current_timestamp())
        net = fold_changes(rows, TICKET_KEYS, TICKET_ORDER, LOGGED_COLS)
        net.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if on_undated is not None:
            on_undated(undated.get["undated"])

    return (pages.writeStream.foreachBatch(apply)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_tickets(spark: SparkSession, path: str) -> DataFrame | None:
    """Tickets as of the last applied batch of the last run; None before the first.

    ``path`` holds one log per run. A ticket seen by several runs belongs to the
    last of them and keeps what the first one found.
    """
    if not path_exists(spark, path):
        return None
    log = spark.read.parquet(path)
    # As applied: a resumed older run writes later than the newer one it follows.
    return fold_changes(log.drop("run"), TICKET_KEYS, ("ingested_at", "run_id", "batch", *TICKET_ORDER),
                        (*LOGGED_COLS, "batch")).drop("batch", "position")
