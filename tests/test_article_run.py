"""The article job: pages to a stored table with vectors of changed versions."""

from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pytest

from topicloom.plans.article_run import ArticleRuns, compact_articles

NOW = datetime(2026, 1, 15)
START = 1765843200  # 30 days before


def embedder():
    def embed(texts):
        if any("fail" in t for t in texts):
            raise RuntimeError("provider is down")
        return np.array([[len(t), 1.0, "[REDACTED]" in t] for t in texts], dtype=float)
    return embed


def article(i, at="2026-01-01T00:00:00Z", body="<p>Some <b>text</b></p>", **more):
    return {"id": i, "title": f"t{i}", "body": body, "locale": "en", "draft": False, "section_id": 3,
            "created_at": "2025-01-01T00:00:00Z", "updated_at": at, **more}


def put(tmp_path, at, *articles, end, more=False, account="a"):
    folder = tmp_path / "feed" / f"feed={account}" / f"at={at}"
    folder.mkdir(parents=True, exist_ok=True)
    page = {"articles": list(articles), "next_page": "more" if more else None, "end_time": end}
    (folder / "page.json").write_text(json.dumps(page))


def job(spark, tmp_path, accounts=("a",)):
    return ArticleRuns(spark, str(tmp_path / "store"), accounts, embedder, 3)


def start(runs, tmp_path, run_id):
    return runs.start_feed(run_id, NOW, 30, path=str(tmp_path / "feed"))


def rows(runs):
    return {(r.account_id, r.article_id): r for r in runs.articles().collect()}


def test_pages_versions_and_counters(spark, tmp_path):
    put(tmp_path, START, article(1), article(2, draft=True), article(3, body=""), article(4, body=None), end=50, more=True)
    put(tmp_path, 50, article(5, body="<p>write to x@example.com</p>"), end=60)
    runs = job(spark, tmp_path)
    done = start(runs, tmp_path, 1)
    assert (done.seen, done.embedded, done.skipped) == (5, 2, 3)
    first = rows(runs)
    assert first["a", 1].clean_text == "Some text" and len(first["a", 1].embedding) == 3
    assert first["a", 5].embedding[2] > 0, "masked before it was embedded"
    assert first["a", 2].embedding is None and first["a", 3].clean_text == first["a", 4].clean_text == ""

    # The next run: 1 as it was, 2 published with its old time, 3 has a text, 5 twice with a change between.
    put(tmp_path, START, article(1, title="new title"), article(2), article(3, "2026-01-02T00:00:00Z"),
        article(5, "2026-01-03T00:00:00Z", "one"), article(5, "2026-01-04T00:00:00Z", "three"), end=50, more=True)
    put(tmp_path, 50, article(5, "2026-01-04T00:00:00Z", "three"), end=60)
    done = start(runs, tmp_path, 2)
    assert (done.seen, done.embedded) == (6, 3)
    second = rows(runs)
    assert second["a", 1].title == "new title" and second["a", 1].embedding == first["a", 1].embedding
    assert second["a", 2].embedding is None, "its stored version is the same, as in a draft that was published"
    assert second["a", 5].embedding[0] == pytest.approx(5 / np.sqrt(26)) and second["a", 5].seen == 4
    assert second["a", 4] == first["a", 4]
    compact_articles(spark, str(tmp_path / "store"), str(tmp_path / "folded"))
    folded = ArticleRuns(spark, str(tmp_path / "folded"), ["a"], embedder, 3)
    assert rows(folded) == second


def test_a_failed_run_goes_on_and_counts_once(spark, tmp_path):
    put(tmp_path, START, article(1), article(2, body="will fail"), end=50)
    runs = job(spark, tmp_path)
    with pytest.raises(Exception, match="provider is down"):
        start(runs, tmp_path, 1)
    assert rows(runs) == {}
    last = {r.status for r in spark.read.parquet(str(tmp_path / "store/article_ledger")).collect()}
    assert last == {"running", "failed"}
    put(tmp_path, START, article(1), article(2), end=50)
    with pytest.raises(Exception, match="provider is down"):
        start(runs, tmp_path, 1)  # the batch is replayed as it was staged
    assert start(runs, tmp_path, 2).embedded == 2
    assert start(runs, tmp_path, 2).seen == 2, "a finished run finds nothing new"


def test_several_accounts_and_no_articles(spark, tmp_path):
    put(tmp_path, START, article(1), end=50)
    put(tmp_path, START, article(1, body="other"), article(9, account_id="z"), end=50, account="b")
    runs = job(spark, tmp_path, ("a", "b", "c"))
    done = start(runs, tmp_path, 1)
    assert (done.seen, done.embedded) == (3, 3)
    assert sorted(rows(runs)) == [("a", 1), ("b", 1), ("b", 9)]
    assert rows(job(spark, tmp_path / "none")) == {}
