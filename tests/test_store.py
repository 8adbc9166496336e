from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from topicloom import scope as S
from topicloom.operators import ledger as L
from topicloom.operators import upsert as U
from topicloom.operators.refresh import merge_articles, refresh_counts, route_articles
from topicloom.operators.sizes import broadcast_if_small, save_bucketed
from topicloom.schemas import ARTICLES

TICKET = "account_id string, ticket_id long, run_id long, subject string, created string, embedding string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_updates_inserts_and_keeps(spark):
    stored = spark.createDataFrame([("a", 1, 1, "old", "c1", "v1"), ("a", 2, 1, "two", "c2", None),
                                    ("b", 1, 1, "other tenant", "c3", None)], TICKET)
    updates = spark.createDataFrame([("a", 1, 2, "new", "cX", None), ("a", 3, 2, None, "c4", None)], TICKET)
    once = U.upsert(stored, updates, ["account_id", "ticket_id"], ["run_id", "subject"])
    assert rows(once) == [("a", 1, 2, "new", "c1", "v1"), ("a", 2, 1, "two", "c2", None),
                          ("a", 3, 2, None, "c4", None), ("b", 1, 1, "other tenant", "c3", None)]
    twice = U.upsert(once, updates, ["account_id", "ticket_id"], ["run_id", "subject"])
    assert rows(twice) == rows(once)


def test_upsert_can_set_null_and_skip_inserts(spark):
    stored = spark.createDataFrame([("a", 1, 1, "old", "c", "v")], TICKET)
    updates = spark.createDataFrame([("a", 1, None), ("a", 2, "x")],
                                    "account_id string, ticket_id long, embedding string")
    merged = U.upsert(stored, updates, ["account_id", "ticket_id"], ["embedding"], insert=False)
    assert rows(merged) == [("a", 1, 1, "old", "c", None)]
    with pytest.raises(ValueError, match="lack"):
        U.upsert(stored, updates, ["account_id", "ticket_id"], ["subject"])


def test_update_columns_need_a_place(spark):
    stored = spark.createDataFrame([(1, "x")], "k int, a string")
    fresh = spark.createDataFrame([(1, "y", 2)], "k int, a string, b int")
    with pytest.raises(ValueError, match="stored table lacks the columns .'b'."):
        U.upsert(stored, fresh, ["k"], ["a", "b"])


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from topicloom.session import is_local, shared_dir

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(
        master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(bare)
    assert is_local("local[8]") and is_local("local") and not is_local("local-cluster[2,1,1024]")


def test_latest_per_key_is_last_not_first(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("j", 1, None)],
                               "key string, version int, v string")
    assert rows(U.latest_per_key(df, ["key"], ["version"])) == [("j", 1, None), ("k", 3, "c")]


def test_fold_changes_equals_upserts_in_order(spark):
    schema = "key string, batch int, created string, subject string"
    log = spark.createDataFrame([("k", 0, "c0", "s0"), ("k", 1, "c1", None), ("j", 1, None, "s1"),
                                 ("k", 2, "c2", "s2"), ("j", 2, "c2", None)], schema)
    folded = U.fold_changes(log, ["key"], ["batch"], ["batch", "subject"])
    state = log.filter("batch = 0")
    for batch in (1, 2):
        state = U.upsert(state, log.filter(F.col("batch") == batch), ["key"], ["batch", "subject"])
    assert sorted(map(str, folded.collect())) == sorted(map(str, state.collect()))


def test_replacing_runs_twice_does_not_duplicate(spark, tmp_path):
    schema = "account_id string, run_id int, x int"
    stored = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", 1, 4)], schema)
    fresh = spark.createDataFrame([("a", 1, 9)], schema)
    want = [("a", 1, 9), ("a", 2, 3), ("b", 1, 4)]
    assert rows(U.replace_runs(stored, fresh)) == want
    path = str(tmp_path / "t")
    for part in (stored, fresh, fresh):
        U.write_runs(part, path)
    assert rows(spark.read.schema(schema).parquet(path).select("account_id", "run_id", "x")) == want
    U.drop_run_partitions(spark, path, fresh)
    assert rows(spark.read.schema(schema).parquet(path).select("account_id", "run_id", "x")) == want[1:]


def test_scope(spark):
    df = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, None), ("b", 1, [1.0])],
                               "account_id string, run_id int, embedding array<double>")
    assert S.scope(df, "a").count() == 2
    assert S.scope(df, "a", 1).count() == 1
    with pytest.raises(ValueError):
        S.scope(df, None)
    df = df.withColumn("ticket_id", F.lit(5))
    assert S.needing_embedding(df).count() == 1
    assert S.embedded(df).count() == 2
    nothing = spark.createDataFrame([], "ticket_id int")
    assert S.by_ids(df, nothing).count() == 0
    tenants = spark.createDataFrame([("acme", 1), ("zeta", 2)], "subdomain string, id int")
    assert S.tenant_by_key(tenants, "zeta").first().id == 2


def test_ledger_and_audit(spark):
    at = datetime(2026, 1, 1)
    events = [("running", None, 1), ("running", "c1", 2), ("failed", None, 3), ("running", None, 4),
              ("completed", None, 5)]
    ledger = None
    for status, cursor, seq in events:
        row = L.run_event(spark, "a", 7, seq, status, at.replace(day=seq), 30, at, cursor)
        ledger = row if ledger is None else ledger.unionByName(row)
    (run,) = L.latest_runs(ledger).collect()
    assert (run.status, run.cursor, run.window_days) == ("completed", "c1", 30)
    assert (run.started_at.day, run.completed_at.day) == (1, 5)
    assert L.latest_runs(ledger.filter("event_seq <= 3")).first().status == "failed"
    with pytest.raises(ValueError):
        L.run_event(spark, "a", 7, 9, "exploded", at)
    clusters = spark.createDataFrame([("a", 7, 3, "boom \"x\""), ("a", 7, 2, None)],
                                     "account_id string, run_id int, ticket_count int, error string")
    (audit,) = L.failure_audit(clusters, F.lit(at)).collect()
    assert audit.detail_json == '{"analysisRunId":7,"ticketCount":3,"error":"boom \\"x\\""}'
    assert audit.event_type == "clustering_cluster_processing_failed"


def article(i, text, updated, draft=False, embedding=None):
    return ("a", i, f"t{i}", text, None, "en", draft, None, updated, embedding, None)


def test_refresh_routes_and_merges(spark):
    old, new = datetime(2025, 1, 1), datetime(2026, 6, 1, 0, 0, 0, 5000)
    stored = spark.createDataFrame([
        article(1, "kept", new, embedding=[1.0]), article(2, "changed", old, embedding=[1.0]),
        article(6, "never embedded", new)], ARTICLES)
    incoming = spark.createDataFrame([
        article(1, "same", new.replace(microsecond=5400)), article(2, "body", new),
        article(3, "fresh", new), article(4, "draft", new, draft=True),
        article(5, "  \n", new), article(6, "text", new)], ARTICLES).drop("embedding", "embedded_at")
    routed = route_articles(incoming, stored)
    assert {r.article_id: (r.action, r.reason) for r in routed.collect()} == {
        1: ("skipped", "unchanged"), 2: ("embedded", "changed"), 3: ("embedded", "new"),
        4: ("skipped", "draft"), 5: ("skipped", "blank"), 6: ("skipped", "unchanged")}
    assert tuple(refresh_counts(routed).first()) == ("a", 6, 2, 4)
    missing = route_articles(incoming, stored, "by_missing").filter("article_id = 6").first()
    assert (missing.action, missing.reason) == ("embedded", "changed")
    with pytest.raises(ValueError):
        route_articles(incoming, stored, "sometimes")

    vectors = spark.createDataFrame([("a", 2, [2.0], new), ("a", 3, [3.0], new)],
                                    "account_id string, article_id long, embedding array<float>, embedded_at timestamp")
    merged = {r.article_id: r for r in merge_articles(stored, routed, vectors).collect()}
    assert sorted(merged) == [1, 2, 3, 4, 5, 6]
    assert (merged[1].clean_text, merged[1].embedding) == ("same", [1.0])
    assert (merged[2].clean_text, merged[2].embedding) == ("body", [2.0])
    assert merged[3].embedding == [3.0] and merged[4].embedding is None
    assert merged[4].draft is True


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_shuffling_the_stored_side(spark, tmp_path):
    df = spark.range(1000).selectExpr(
        "concat('a', id % 2) as account_id", "id as ticket_id", "cast(id as string) as subject")
    name = "bucketed_tickets"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS shelf LOCATION '{tmp_path}/shelf'")
        save_bucketed(df, f"shelf.{name}", ["account_id", "ticket_id"], 4)
        members = df.select("account_id", "ticket_id").filter("ticket_id < 10")
        joined = spark.table(f"shelf.{name}").join(members, ["account_id", "ticket_id"])
        assert joined.count() == 10
        assert plan(joined).count("Exchange hashpartitioning") == 1
    finally:
        spark.sql(f"DROP TABLE IF EXISTS shelf.{name}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcast_only_below_the_checked_size(spark):
    big = spark.range(100000).selectExpr("id", "id % 7 as x")
    small = spark.range(50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in plan(big.join(broadcast_if_small(small, 50), "id"))
        assert "BroadcastHashJoin" not in plan(big.join(broadcast_if_small(small, 49), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_last_write_is_merged_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as key", "id as version", "'v' as v")
    text = plan(U.latest_per_key(df, ["key"], ["version"]))
    assert "partial_max_by" in text and "Window" not in text
