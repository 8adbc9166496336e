"""Feeds whose next page is known only from the page just read."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from topicloom.plans.ingest_run import IngestRuns
from topicloom.schemas import ARTICLE_PAGE, TICKET_PAGE
from topicloom.sources import pages as P
from topicloom.sources.chain import Stage, stream_chain

NOW = datetime(2026, 1, 15)
START = 1765843200  # 30 days before


class OneByOne:
    """Knows the page at a position and nothing else; notes what it was asked for."""

    def __init__(self, options):
        self.folder = Path(options["folder"])

    def page(self, feed, position):
        ((kind, at),) = position.items()
        with (self.folder / "asked").open("a") as asked:
            asked.write(f"{feed} {kind} {at}\n")
        return (self.folder / f"{feed}-{kind}-{at}").read_text()


def put(folder, at, *ids, after, last=False, feed="a", kind="cursor", subject="s"):
    folder.mkdir(parents=True, exist_ok=True)
    tickets = [{"id": i, "subject": subject, "description": f"d{i}", "created_at": "2026-01-02T00:00:00Z",
                "generated_timestamp": 1} for i in ids]
    page = {"tickets": tickets, "end_of_stream": last, "after_cursor": after}
    (folder / f"{feed}-{kind}-{at}").write_text(json.dumps(page))


def asked(folder):
    return (folder / "asked").read_text().split("\n")[:-1]


def transport(folder, **more):
    return {"transport": "test_chain:OneByOne", "folder": str(folder), **more}


def drain(spark, tmp_path, feeds=("a",), follow="cursor", schema=TICKET_PAGE, **more):
    pages = stream_chain(spark, str(tmp_path / "stage"), follow, START, feeds, schema, **transport(tmp_path / "feed", **more))
    rows = P.tickets_of(pages) if follow == "cursor" else P.placed_articles(pages)
    query = (rows.select("account_id", "id", "position").writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.schema("account_id string, id long, position long").parquet(str(tmp_path / "out")).collect()
    return [(r.account_id, r.id) for r in sorted(rows, key=lambda r: (r.account_id, r.position))]


def test_a_chain_is_followed_from_its_start_time(spark, tmp_path):
    feed = tmp_path / "feed"
    put(feed, START, 5, 4, after="x", kind="start_time")
    put(feed, "x", 3, after="b")
    put(feed, "b", after="a9")
    put(feed, "a9", 1, 2, after="end", last=True)
    assert drain(spark, tmp_path) == [("a", k) for k in (5, 4, 3, 1, 2)]
    assert asked(feed) == [f"a start_time {START}", "a cursor x", "a cursor b", "a cursor a9"]

    # Nothing new: asked once where the feed ended, nothing kept.
    put(feed, "end", after="end", last=True)
    assert len(drain(spark, tmp_path)) == 5
    assert asked(feed)[4:] == ["a cursor end"] and Stage(str(tmp_path / "stage"), "a").last() == 4

    put(feed, "end", 9, after="end2", last=True)
    assert drain(spark, tmp_path)[5:] == [("a", 9)]


def test_a_restart_in_the_middle_repeats_and_loses_nothing(spark, tmp_path):
    feed = tmp_path / "feed"
    put(feed, START, 1, after="c1", kind="start_time")
    for k in range(1, 6):
        put(feed, f"c{k}", k + 1, after=f"c{k + 1}", last=k == 5)
    seen = [drain(spark, tmp_path, max_pages="2") for _ in range(3)]
    assert seen == [[("a", k) for k in range(1, n + 1)] for n in (2, 4, 6)]
    assert len(asked(feed)) == len(set(asked(feed))) == 6


def test_feeds_are_walked_side_by_side(spark, tmp_path):
    feed = tmp_path / "feed"
    for name, pages in (("a", 3), ("b/ü", 1), ("", 2)):
        put(feed, START, 10, after="c1", kind="start_time", feed=name.replace("/", "_"), last=pages == 1)
        for k in range(1, pages):
            put(feed, f"c{k}", 10 + k, after=f"c{k + 1}", last=k == pages - 1, feed=name.replace("/", "_"))
    assert drain(spark, tmp_path, feeds=("a", "b_ü", "")) == [
        ("", 10), ("", 11), ("a", 10), ("a", 11), ("a", 12), ("b_ü", 10)]


def test_time_paged_articles(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    for at, ids, follows, end in ((START, [1, 2], "more", 7), (7, [3], "more", 9), (9, [2], None, 12)):
        page = {"articles": [{"id": i} for i in ids], "next_page": follows, "end_time": end}
        (feed / f"a-start_time-{at}").write_text(json.dumps(page))
    assert drain(spark, tmp_path, follow="time", schema=ARTICLE_PAGE) == [("a", k) for k in (1, 2, 3, 2)]


@pytest.mark.parametrize(("page", "reason"), [
    ('{"tickets": [', "does not parse"), ("[1]", "is no object"),
    ('{"tickets": [], "end_of_stream": false}', "has no after_cursor"),
    ('{"tickets": [], "end_of_stream": false, "after_cursor": "c1"}', "leads back to itself")])
def test_a_page_that_cannot_be_followed_stops_the_feed(spark, tmp_path, page, reason):
    feed = tmp_path / "feed"
    put(feed, START, 1, after="c1", kind="start_time")
    (feed / "a-cursor-c1").write_text(page)
    with pytest.raises(Exception, match=reason):
        drain(spark, tmp_path)
    put(feed, "c1", 2, after="c2", last=True)
    assert drain(spark, tmp_path) == [("a", 1), ("a", 2)]
    assert asked(feed) == [f"a start_time {START}", "a cursor c1", "a cursor c1"]


def test_runs_over_a_chained_feed(spark, tmp_path):
    feed, runs = tmp_path / "feed", IngestRuns(spark, str(tmp_path / "store"), "a")
    put(feed, START, 1, after="c1", kind="start_time")
    put(feed, "c1", 2, 1, after="c2", last=True, subject="later")
    put(feed, "c2", after="c2", last=True)
    done = runs.start_feed(5, 30, NOW, max_pages="1", **transport(feed))
    assert (done.tickets, runs.status(5)) == (2, "completed")
    assert {r.ticket_id: r.subject for r in runs.tickets().collect()} == {1: "later", 2: "later"}
    last = runs.ledger.where("status = 'completed'").first()
    assert json.loads(last.cursor) == {"cursor": "c2"}
    put(feed, "c2", 3, after="c3", last=True)
    put(feed, "c3", after="c3", last=True)
    assert runs.resume_feed(5, **transport(feed)).tickets == 3
    with pytest.raises(ValueError, match="No run 6"):
        runs.resume_feed(6, **transport(feed))
    with pytest.raises(ValueError, match="window of 45"):
        runs.start_feed(6, 45, NOW, **transport(feed))


def test_a_failed_batch_is_replayed_from_the_stage(spark, tmp_path):
    """What a batch could not apply is read again as it was, though the feed has changed."""
    feed, runs = tmp_path / "feed", IngestRuns(spark, str(tmp_path / "store"), "a")
    put(feed, START, 1, after="c1", kind="start_time")
    put(feed, "c1", 2, after="c2", last=True)
    down = spark.range(1).select(F.lit("a").alias("account_id"), *[
        F.raise_error(F.lit("triage is down")).cast("long").alias(f"{n}_field") for n in ("category", "intent", "sentiment")])
    with pytest.raises(Exception, match="triage is down"):
        runs.start_feed(5, 30, NOW, triage=down, **transport(feed))
    assert runs.status(5) == "failed" and runs.tickets() is None
    put(feed, START, 8, 9, after="c1", kind="start_time")
    put(feed, "c2", after="c2", last=True)
    assert runs.resume_feed(5, **transport(feed)).tickets == 2
    assert sorted(r.ticket_id for r in runs.tickets().collect()) == [1, 2]
    assert asked(feed) == [f"a start_time {START}", "a cursor c1", "a cursor c2"]
