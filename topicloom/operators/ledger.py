"""Run ledger and audit log: append-only tables with a latest view."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.schemas import RUN_LEDGER, RUN_STATUSES

# --- Fixed values: event name and detail keys of a failed cluster ---
CLUSTER_FAILED = "clustering_cluster_processing_failed"
DETAIL_KEYS = ("analysisRunId", "ticketCount", "error")
# --- end of fixed values ---


def run_event(spark: SparkSession, account_id: str, run_id: int, event_seq: int, status: str,
              at: datetime, window_days: int | None = None, as_of: datetime | None = None,
              cursor: str | None = None) -> DataFrame:
    """One ledger row; append it to the ledger table."""
    if status not in RUN_STATUSES:
        raise ValueError(f"unknown run status {status!r}")
    row = (account_id, run_id, event_seq, window_days, as_of, status, cursor, at)
    return spark.createDataFrame([row], RUN_LEDGER)


def latest_runs(ledger: DataFrame) -> DataFrame:
    """Current state of every run: last status and cursor, start and completion."""
    seq = F.col("event_seq")
    return ledger.groupBy("account_id", "run_id").agg(
        F.max("window_days").alias("window_days"),
        F.max_by("status", seq).alias("status"),
        F.max_by("cursor", F.when(F.col("cursor").isNotNull(), seq)).alias("cursor"),
        F.min("at").alias("started_at"),
        F.max(F.when(F.col("status") == "completed", F.col("at"))).alias("completed_at"),
    )


def failure_audit(clusters: DataFrame, at) -> DataFrame:
    """Audit rows of the clusters whose ``error`` is set. ``at``: a timestamp column."""
    detail = F.struct(
        F.col("run_id").alias(DETAIL_KEYS[0]),
        F.col("ticket_count").alias(DETAIL_KEYS[1]),
        F.col("error").alias(DETAIL_KEYS[2]),
    )
    return clusters.filter(F.col("error").isNotNull()).select(
        "account_id", F.lit(CLUSTER_FAILED).alias("event_type"),
        F.to_json(detail).alias("detail_json"), at.alias("created_at"),
    )
