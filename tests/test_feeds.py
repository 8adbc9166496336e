from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from topicloom.operators import ingest as I
from topicloom.plans.ingest_run import IngestRuns
from topicloom.schemas import ARTICLE_PAGE, TICKET_PAGE
from topicloom.sources import pages as P
from topicloom.streaming.ingest import TICKET_KEYS, TICKET_ORDER, LOGGED_COLS, compact, read_change_log

NOW = datetime(2026, 1, 15)


def ticket(i, created="2026-01-02T00:00:00Z", subject="s", at=1, **more):
    return {"id": i, "subject": subject, "description": f"d{i}", "status": "open", "tags": ["x"],
            "created_at": created, "generated_timestamp": at, **more}


def page(folder: Path, name: str, *tickets, last=False, account="a"):
    folder.mkdir(parents=True, exist_ok=True)
    body = {"account_id": account, "tickets": list(tickets), "end_of_stream": last, "after_cursor": name}
    (folder / f"{name}.json").write_text(json.dumps(body) + "\n")


def test_window_checks_come_first():
    with pytest.raises(ValueError, match="window of 45 days"):
        I.check_window(45)
    assert [I.check_window(d) for d in (30, 60, 90)] == [30, 60, 90]


def test_window_keeps_its_boundary(spark):
    df = spark.createDataFrame(
        [(1, datetime(2025, 12, 16)), (2, datetime(2025, 12, 15, 23, 59, 59)), (3, None), (4, NOW)],
        "id int, created_at timestamp")
    assert [r.id for r in I.in_window(df, "created_at", NOW, 30).collect()] == [1, 4]


def test_triage_values_must_be_text(spark, tmp_path):
    fields = [{"id": 5, "value": "billing"}, {"id": 6, "value": 7}, {"id": 7, "value": None},
              {"id": 6, "value": "late"}]
    page(tmp_path, "p1", ticket(1, custom_fields=fields), ticket(2),
         ticket(3, custom_fields=[{"id": 7, "value": True}, {"id": 5, "value": ""}]))
    meta = {"account_id": "a", "ticket_fields": [
        {"id": 1, "type": "t", "title": "Category"}, {"id": 6, "type": "t", "title": "intent"},
        {"id": 5, "type": "t", "title": " CATEGORY "}, {"id": 7, "type": "t", "title": "Sentiment"},
        {"id": 9, "type": "t", "title": "Priority"}]}
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "f.json").write_text(json.dumps(meta))
    dimension = I.triage_dimension(P.read_ticket_fields(spark, str(tmp_path / "meta")))
    assert tuple(dimension.first()) == ("a", 5, 6, 7)
    rows = I.with_triage(P.read_tickets(spark, str(tmp_path)), dimension).orderBy("id").collect()
    assert [(r.category, r.intent, r.sentiment) for r in rows] == [
        ("billing", None, None), (None, None, None), ("", None, None)]


def test_ticket_mapping_fills_gaps(spark, tmp_path):
    page(tmp_path, "p1", {"id": 1}, ticket(2, created="garbage"))
    one, two = I.map_tickets(P.read_tickets(spark, str(tmp_path))).orderBy("ticket_id").collect()
    assert (one.subject, one.first_comment, one.tags, one.created_at) == (None, None, [], None)
    assert (two.first_comment, two.created_at) == ("d2", None)


def test_unparsable_page_is_set_aside(spark, tmp_path):
    page(tmp_path, "p1", ticket(1))
    (tmp_path / "p2.json").write_text("{broken\n")
    pages = P.read_page_files(spark, str(tmp_path), TICKET_PAGE).cache()
    assert pages.filter(F.col("_corrupt_record").isNotNull()).count() == 1
    assert [r.reason for r in P.page_rejects(pages, "tickets").collect()] == ["a page does not parse"]
    with pytest.raises(Exception, match="a page does not parse"):
        P.tickets_of(pages).collect()


@pytest.mark.parametrize("text,reason", [
    ('{"account_id": "a", "tickets": [{"id": 2}, {"subject": "s"}]}', "one of tickets has no id"),
    ('{"account_id": "a", "tickets": [{"id": "x1"}]}', "."),
    ('{"account_id": "a"}', "a page has no tickets"),
    ('{"account_id": "a", "tickets": [{"id": 3', "a page does not parse"),
])
def test_broken_page_fails_the_run_before_its_offset_is_committed(spark, tmp_path, text, reason):
    feed = tmp_path / "feed"
    page(feed, "p1", ticket(1))
    (feed / "p2.json").write_text(text + "\n")
    runs = runs_of(spark, tmp_path)
    with pytest.raises(Exception, match=reason):
        runs.start(P.stream_page_files(spark, str(feed), TICKET_PAGE), 3, 30, NOW)
    assert runs.status(3) == "failed"
    with pytest.raises(Exception, match=reason):
        runs.resume(P.stream_page_files(spark, str(feed), TICKET_PAGE), 3)
    page(feed, "p2", ticket(2))
    assert runs.resume(P.stream_page_files(spark, str(feed), TICKET_PAGE), 3).tickets == 2


def test_other_accounts_and_unparsable_times(spark, tmp_path):
    page(tmp_path / "feed", "p1", ticket(1), ticket(2, "yesterday"), ticket(3, None))
    page(tmp_path / "feed", "p2", ticket(1, subject="other"), account="b")
    runs = runs_of(spark, tmp_path)
    done = runs.start(P.stream_page_files(spark, str(tmp_path / "feed"), TICKET_PAGE), 1, 30, NOW)
    assert (done.tickets, done.undated) == (1, 1)
    assert [(r.account_id, r.subject) for r in runs.tickets().collect()] == [("a", "s")]


def test_a_resumed_older_run_wins_as_it_writes_last(spark, tmp_path):
    feed = tmp_path / "feed"
    page(feed, "p1", ticket(1, subject="one"))
    runs = runs_of(spark, tmp_path)
    runs.start(P.stream_page_files(spark, str(feed), TICKET_PAGE), 1, 30, NOW)
    runs.start(P.stream_page_files(spark, str(feed), TICKET_PAGE), 2, 30, NOW)
    page(feed, "p2", ticket(1, subject="two", at=2))
    runs.resume(P.stream_page_files(spark, str(feed), TICKET_PAGE), 1)
    row = runs.tickets().first()
    assert (row.run_id, row.subject) == (1, "two")


def test_article_mapping(spark, tmp_path):
    body = {"account_id": "a", "next_page": None, "end_time": 5, "articles": [
        {"id": 1, "title": "t", "body": "<p>Hold the <b>red</b> button.</p>", "locale": "en", "draft": False,
         "updated_at": "2026-06-01T00:00:00Z"}, {"id": 2, "body": None}]}
    (tmp_path / "a.json").write_text(json.dumps(body))
    one, two = I.map_articles(P.read_articles(spark, str(tmp_path))).orderBy("article_id").collect()
    assert (one.clean_text, one.updated_at) == ("Hold the red button.", datetime(2026, 6, 1))
    assert (two.clean_text, two.draft) == ("", False)


def test_page_feed_batch_and_stream(spark, tmp_path):
    feed, out = tmp_path / "feed", tmp_path / "out"
    page(feed, "p1", ticket(1))
    page(feed, "p2", ticket(2), ticket(3))
    spark.dataSource.register(P.PageFeed)
    fetched = spark.read.format("page_feed").option("path", str(feed)).load()
    pages = P.parsed_pages(fetched, TICKET_PAGE)
    assert sorted(r.id for r in P.tickets_of(pages).collect()) == [1, 2, 3]
    resumed = spark.read.format("page_feed").option("path", str(feed)).option("start", "p1.json").load()
    assert [r.cursor for r in resumed.collect()] == ["p2.json"]

    def drain():
        stream = spark.readStream.format("page_feed").option("path", str(feed)).load()
        query = (stream.writeStream.format("parquet").option("path", str(out))
                 .option("checkpointLocation", str(tmp_path / "offsets"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return sorted(r.cursor for r in spark.read.schema("cursor string, body string").parquet(str(out)).collect())

    assert drain() == ["p1.json", "p2.json"]
    page(feed, "p3", ticket(4), last=True)
    assert drain() == ["p1.json", "p2.json", "p3.json"]


class TwoPages:
    """A transport that is not a folder."""

    def __init__(self, options):
        self.options = options

    def cursors(self, after):
        return [c for c in ("1", "2") if c > after]

    def fetch(self, cursor):
        yield json.dumps({"account_id": self.options["account"], "articles": [{"id": int(cursor)}],
                          "next_page": None, "end_time": 1})


def test_page_feed_with_own_transport(spark):
    spark.dataSource.register(P.PageFeed)
    fetched = (spark.read.format("page_feed").option("transport", "test_feeds:TwoPages")
               .option("account", "z").load())
    rows = P.articles_of(P.parsed_pages(fetched, ARTICLE_PAGE)).orderBy("id").collect()
    assert [(r.account_id, r.id) for r in rows] == [("z", 1), ("z", 2)]


def runs_of(spark, tmp_path):
    return IngestRuns(spark, str(tmp_path / "store"), "a")


def test_ingest_pages_resume_and_repeat(spark, tmp_path):
    feed = tmp_path / "feed"
    page(feed, "p1", ticket(101, "2026-01-01T00:00:00Z"), ticket(7, "2020-01-01T00:00:00Z"), ticket(8, None))
    page(feed, "p2", ticket(102, "2026-01-02T00:00:00Z"))
    runs = runs_of(spark, tmp_path)
    stream = P.stream_page_files(spark, str(feed), TICKET_PAGE)
    assert runs.start(stream, 5, 30, NOW).tickets == 2
    assert runs.status(5) == "completed"
    before = {r.ticket_id: r for r in runs.tickets().collect()}

    page(feed, "p3", ticket(101, "2026-01-03T00:00:00Z", subject="changed", at=9, status="closed"), last=True)
    assert runs.resume(P.stream_page_files(spark, str(feed), TICKET_PAGE), 5).tickets == 2
    after = {r.ticket_id: r for r in runs.tickets().collect()}
    assert (after[101].subject, after[101].status) == ("changed", "closed")
    assert after[101].created_at == before[101].created_at
    assert after[101].ingested_at == before[101].ingested_at
    assert after[102] == before[102]

    # A later run over the same feed takes the tickets over.
    assert runs.start(P.stream_page_files(spark, str(feed), TICKET_PAGE), 6, 30, NOW).tickets == 2
    taken = {r.ticket_id: r for r in runs.tickets().collect()}
    assert {r.run_id for r in taken.values()} == {6}
    assert taken[101].ingested_at == before[101].ingested_at


def test_repeated_ticket_in_one_batch_is_stored_once(spark, tmp_path):
    page(tmp_path / "feed", "p1", ticket(999, subject="first"), ticket(999, subject="second"))
    runs = runs_of(spark, tmp_path)
    stream = P.stream_page_files(spark, str(tmp_path / "feed"), TICKET_PAGE)
    assert runs.start(stream, 1, 60, NOW).tickets == 1
    assert runs.tickets().first().subject == "second"
    run_log, target = str(tmp_path / "store/tickets/run=1"), str(tmp_path / "compacted")
    compact(spark, run_log, target, TICKET_KEYS, TICKET_ORDER, LOGGED_COLS)
    same = read_change_log(spark, target, TICKET_KEYS, TICKET_ORDER, LOGGED_COLS)
    assert same.first().subject == "second" and same.count() == 1


def test_failed_source_marks_the_run_and_can_resume(spark, tmp_path):
    feed = tmp_path / "feed"
    page(feed, "p1", ticket(1))
    runs = runs_of(spark, tmp_path)
    broken = P.stream_page_files(spark, str(feed), TICKET_PAGE).withColumn(
        "account_id", F.raise_error(F.lit("feed is down")).cast("string"))
    with pytest.raises(Exception, match="feed is down"):
        runs.start(broken, 3, 30, NOW)
    assert runs.status(3) == "failed"
    with pytest.raises(ValueError, match="window of 45 days"):
        runs.start(broken, 4, 45, NOW)
    assert runs.status(4) is None
    with pytest.raises(ValueError, match="No run 9"):
        runs.resume(broken, 9)
    assert runs.resume(P.stream_page_files(spark, str(feed), TICKET_PAGE), 3).tickets == 1
    assert runs.status(3) == "completed"
