"""One ticket ingest run: ledger rows around the page stream."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.ingest import check_window
from topicloom.operators.ledger import latest_runs, run_event
from topicloom.operators.sizes import broadcast_if_small
from topicloom.schemas import RUN_LEDGER, TICKET_PAGE
from topicloom.session import path_exists
from topicloom.sources.chain import Stage, stream_chain
from topicloom.streaming.ingest import current_tickets, ingest_tickets


@dataclass(frozen=True)
class IngestResult:
    run_id: int
    tickets: int
    undated: int = 0  # tickets seen whose creation time does not parse


class IngestRuns:
    """Runs of one account, stored below ``root``.

    The stream's checkpoint is the cursor: after a failure ``resume`` goes on
    with the first page not fully applied. The window start is fixed when a run
    begins and kept in the ledger, so a resumed run covers the same window.
    """

    def __init__(self, spark: SparkSession, root: str, account_id: str):
        self.spark, self.root, self.account_id = spark, root.rstrip("/"), account_id

    @property
    def ledger(self) -> DataFrame:
        path = f"{self.root}/run_ledger"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], RUN_LEDGER)
        return self.spark.read.schema(RUN_LEDGER).parquet(path)

    def tickets(self) -> DataFrame | None:
        return current_tickets(self.spark, f"{self.root}/tickets")

    def start(self, pages: DataFrame, run_id: int, window_days: int, as_of: datetime,
              triage: DataFrame | None = None) -> IngestResult:
        check_window(window_days)
        return self._drive(pages, run_id, window_days, as_of, triage)

    def resume(self, pages: DataFrame, run_id: int, triage: DataFrame | None = None) -> IngestResult:
        return self._drive(pages, run_id, *self._begun(run_id), triage)

    def start_feed(self, run_id: int, window_days: int, as_of: datetime, triage: DataFrame | None = None,
                   **transport: str) -> IngestResult:
        """A run over the account's cursor-chained feed, from the start of its window.

        ``transport``: options of ``page_chain`` that say how a page is fetched.
        """
        check_window(window_days)
        return self._drive(self._feed(run_id, window_days, as_of, transport), run_id, window_days, as_of, triage, chained=True)

    def resume_feed(self, run_id: int, triage: DataFrame | None = None, **transport: str) -> IngestResult:
        """Goes on with the pages that are staged and not applied, then where the feed was left."""
        begun = self._begun(run_id)
        return self._drive(self._feed(run_id, *begun, transport), run_id, *begun, triage, chained=True)

    def _feed(self, run_id: int, window_days: int, as_of: datetime, transport: dict[str, str]) -> DataFrame:
        start = as_of.replace(tzinfo=as_of.tzinfo or UTC) - timedelta(days=window_days)
        return stream_chain(self.spark, self._stage(run_id), "cursor", int(start.timestamp()),
                            [self.account_id], TICKET_PAGE, **transport)

    def _stage(self, run_id: int) -> str:
        return f"{self.root}/stage/run={run_id}"

    def _begun(self, run_id: int) -> tuple[int, datetime]:
        rows = self.ledger.filter(
            (F.col("account_id") == self.account_id) & (F.col("run_id") == run_id))
        begun = rows.agg(F.max("window_days"), F.min("as_of")).first()
        if begun[0] is None:
            raise ValueError(f"No run {run_id} to resume")
        return begun[0], begun[1]

    def status(self, run_id: int) -> str | None:
        row = latest_runs(self.ledger).filter(
            (F.col("account_id") == self.account_id) & (F.col("run_id") == run_id)).first()
        return row["status"] if row else None

    def _drive(self, pages: DataFrame, run_id: int, window_days: int, as_of: datetime,
               triage: DataFrame | None, chained: bool = False) -> IngestResult:
        if triage is not None:
            triage = broadcast_if_small(triage)
        offsets = f"{self.root}/offsets/run={run_id}"
        self._record(run_id, window_days, as_of, "running")
        undated: list[int] = []
        try:
            last, more = None, True
            while more:
                query = ingest_tickets(pages, f"{self.root}/tickets/run={run_id}", offsets, run_id,
                                       window_days, as_of, triage, self.account_id, undated.append)
                query.awaitTermination()
                # A restart may end with the batch that had failed, and a batch may have a
                # bound: a feed is asked until it has no more.
                more = chained and query.lastProgress is not None and query.lastProgress["numInputRows"] > 0
                last = query.lastProgress or last
        except Exception:
            self._record(run_id, window_days, as_of, "failed")
            raise
        self._record(run_id, window_days, as_of, "completed", self._cursor(run_id, last))
        stored = self.tickets()
        own = (F.col("account_id") == self.account_id) & (F.col("run_id") == run_id)
        mine = 0 if stored is None else stored.filter(own).count()
        return IngestResult(run_id, mine, sum(undated))

    def _cursor(self, run_id: int, progress) -> str | None:
        """Where the feed was left; of streams without a chain the last batch."""
        stage = Stage(self._stage(run_id), self.account_id)
        last = stage.last()
        if last:
            return json.dumps(stage.read(last)["after"])
        return f"batch {progress['batchId']}" if progress else None

    def _record(self, run_id: int, window_days: int, as_of: datetime, status: str,
                cursor: str | None = None) -> None:
        row = run_event(self.spark, self.account_id, run_id, time.time_ns() // 1000, status,
                        datetime.now(UTC), window_days, as_of, cursor)
        row.write.mode("append").parquet(f"{self.root}/run_ledger")
