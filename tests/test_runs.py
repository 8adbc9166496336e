from __future__ import annotations

from datetime import datetime

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators.models import hashing_embedder
from topicloom.plans import runs as R
from topicloom.schemas import ARTICLES
from topicloom.streaming.leader import stream_leaders, streamed_clusters, streamed_members

AT = datetime(2026, 1, 1)
SCHEMA = ("account_id string, run_id long, ticket_id long, subject string, description string, "
          "embedding array<double>")


def tickets(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sample(spark):
    return tickets(spark, [
        ("a", 1, 1, "refund", "my refund", [1.0, 0.0, 0.0]), ("a", 1, 2, "refund", "late", [0.99, 0.01, 0.0]),
        ("a", 1, 3, "login", None, [0.0, 0.0, 1.0]),
        ("b", 1, 4, "alone", "x", [0.0, 1.0, 0.0])])


def failing():
    def answer(prompt):
        raise RuntimeError("down")
    return answer


def test_cluster_runs_end_to_end(spark, tmp_path):
    run = R.cluster_runs(sample(spark), 0.9, at=AT)
    (cluster,) = run.clusters.collect()
    assert (cluster.account_id, cluster.cluster_id, cluster.ticket_count) == ("a", 1, 2)
    assert cluster.representative_ids == [1, 2]
    assert cluster.label.split()[0] == "refund"
    assert cluster.centroid == pytest.approx([0.995, 0.005, 0.0])
    want = 1 - brute.similarity(np.array([1.0, 0, 0]), np.array([0.995, 0.005, 0]))
    assert {r.ticket_id: r.distance for r in run.members.collect()}[1] == pytest.approx(want)
    assert {r.account_id: tuple(r)[2:] for r in run.summary.collect()} == {"a": (1, 2, 1), "b": (0, 0, 1)}
    assert run.audit.count() == 0
    assert [r.cluster_id for r in R.cluster_list(run.clusters).collect()] == [1]


def test_failed_labels_keep_the_cluster_and_are_audited(spark, tmp_path):
    path = str(tmp_path / "store")
    for _ in range(2):
        run = R.cluster_runs(sample(spark), 0.9, generate=failing, at=AT)
        R.save_clustering(run, path)
    (cluster,) = R.stored_clustering(spark, path, R.CLUSTERS).collect()
    assert cluster.label == "Unlabeled cluster"
    assert R.stored_clustering(spark, path, R.MEMBERS).count() == 2
    audit = R.stored_clustering(spark, path, R.AUDIT).collect()
    assert len(audit) == 2 and '"error":"down"' in audit[0].detail_json

    # With a stricter threshold nothing groups: the stored run empties.
    R.save_clustering(R.cluster_runs(sample(spark), 0.99999, at=AT), path)
    assert R.stored_clustering(spark, path, R.CLUSTERS).count() == 0


def test_readers_see_one_version_at_a_time(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    R.save_clustering(R.cluster_runs(sample(spark), 0.9, at=AT), path)
    seen = lambda: [sorted(map(str, R.stored_clustering(spark, path, name).collect())) for name in (R.CLUSTERS, R.MEMBERS)]
    before = seen()
    broken = R.cluster_runs(sample(spark), 0.99999, at=AT)
    with monkeypatch.context() as patched:
        patched.setattr(R, "COMMITS", "\0")  # the commit itself cannot be written
        with pytest.raises(Exception):
            R.save_clustering(broken, path)
    assert seen() == before
    gone = spark.createDataFrame([("a", 1)], sample(spark).select("account_id", "run_id").schema)
    none_left = R.cluster_runs(sample(spark).filter("account_id = 'b'"), 0.9, at=AT)
    R.save_clustering(none_left, path, gone)
    assert R.stored_clustering(spark, path, R.CLUSTERS).count() == 0


def test_one_job_from_tickets_to_totals(spark, tmp_path):
    tickets = spark.createDataFrame(
        [("a", 1, 1, "late parcel", "where is my parcel"), ("a", 1, 2, "late parcel", "where is the parcel"),
         ("a", 1, 3, "password", "cannot log in"), ("a", 1, 4, None, " ")],
        "account_id string, run_id long, ticket_id long, subject string, description string")
    runs = spark.createDataFrame([("a", 1), ("a", 2)], "account_id string, run_id long")
    path = str(tmp_path / "store")
    rows = R.run_clustering(tickets, hashing_embedder(256), path, runs=runs, dimension=256, threshold=0.6, at=AT).collect()
    totals = {r.run_id: (r.clusters_created, r.tickets_clustered, r.tickets_unclustered, r.tickets_without_vector) for r in rows}
    assert totals == {1: (1, 2, 1, 1), 2: (0, 0, 0, 0)}
    assert [r.ticket_count for r in R.stored_clustering(spark, path, R.CLUSTERS).collect()] == [2]


def test_embedding_job(spark):
    todo = tickets(spark, [("a", 1, 1, "s", "mail me at a@b.co", None), ("a", 1, 2, "", "  ", None),
                           ("a", 1, 3, "done", "x", [1.0])])
    assert tuple(R.embed_counts(todo).first()) == ("a", 1, 1, 1)
    seen = R.masked_ticket_text(todo).orderBy("ticket_id").first().text
    assert seen == "s\n\nmail me at [REDACTED]"
    vectors = R.embed_tickets(todo, hashing_embedder(8), 8)
    assert [r.ticket_id for r in vectors.collect()] == [1]
    merged = {r.ticket_id: r.embedding for r in R.with_new_vectors(
        todo, vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))).collect()}
    assert len(merged[1]) == 8 and merged[2] is None and merged[3] == [1.0]


def test_article_refresh_job(spark):
    columns = "account_id string, article_id long, title string, clean_text string, section_id long, " \
              "locale string, draft boolean, created_at timestamp, updated_at timestamp"
    incoming = spark.createDataFrame([
        ("a", 1, "t", "write to a@b.co", None, "en", False, None, AT),
        ("a", 2, "t", "hidden", None, "en", True, None, AT)], columns)
    stored = spark.createDataFrame([], ARTICLES)
    first = {r.article_id: r for r in R.refresh_articles(incoming, stored, hashing_embedder(4), AT, 4).collect()}
    assert len(first[1].embedding) == 4 and first[1].embedded_at == AT
    assert first[2].embedding is None
    table = spark.createDataFrame(list(first.values()), ARTICLES)
    later = AT.replace(year=2027)
    again = R.refresh_articles(incoming, table, hashing_embedder(4), later, 4)
    assert {r.article_id: r.embedded_at for r in again.collect()} == {1: AT, 2: None}


@pytest.mark.parametrize("chunk_rows,fold_every", [(4096, 16), (15, 1), (4096, 2)])
def test_streamed_clusters_equal_the_batch_job(spark, tmp_path, chunk_rows, fold_every):
    vectors = brute.planted(5, 90, 8, 0.3, seed=2)
    rows = [("a" if i % 3 else "b", 1, i, None, None, v.tolist()) for i, v in enumerate(vectors)]
    inbox = str(tmp_path / "inbox")
    # Some tickets come again; in one batch only one account has arrivals.
    for low, high in ((0, 40), (30, 31), (35, 55), (55, 90)):
        tickets(spark, rows[low:high]).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SCHEMA).parquet(inbox)
        stream_leaders(stream, str(tmp_path / "out"), str(tmp_path / "offsets"), 0.6,
                       chunk_rows=chunk_rows, fold_every=fold_every).awaitTermination()
    got = {(r.account_id, r.ticket_id): r.cluster_id for r in streamed_members(
        spark, str(tmp_path / "out"), tickets(spark, rows)).collect()}
    want = {}
    for account in "ab":
        mine = [(r[2], r[5]) for r in rows if r[0] == account]
        want.update({(account, t): c for t, c in brute.leaders(mine, 0.6).items()})
    assert got == want
    clusters = streamed_clusters(spark, str(tmp_path / "out"), tickets(spark, rows)).collect()
    held = {(r.account_id, r.cluster_id): r.member_count for r in clusters}
    assert held == {g: list((a, c) for (a, _), c in want.items()).count(g) for g in {(a, c) for (a, _), c in want.items()}}


def test_streamed_state_read_by_a_batch_does_not_grow(spark, tmp_path):
    """Thirteen batches of one account, after others that stay idle; some are replayed."""
    from topicloom.operators.leader import CLUSTER, MEMBER, leader_pass
    from topicloom.streaming.leader import BucketState

    out, vectors = str(tmp_path / "out"), brute.planted(4, 130, 6, 0.3, seed=3)
    rows = [("idle%d" % i, 1, i, None, None, vectors[i].tolist()) for i in range(30)]
    rows += [("busy", 1, i, None, None, v.tolist()) for i, v in enumerate(vectors[30:], 30)]
    table = tickets(spark, rows).select("account_id", "run_id", "ticket_id", "embedding")
    fields = [table.schema[k] for k in ("account_id", "run_id")]
    state = BucketState(spark, out, ("account_id", "run_id"), fields, 16)
    busy = table.where("account_id = 'busy'").select(state.bucket()).first()[0]
    seen = []
    for n, (low, high) in enumerate([(0, 30)] + [(k, k + 8) for k in range(30, 126, 8)]):
        part = table.where(f"ticket_id >= {low} and ticket_id < {high}")
        for _ in range(2 if n in (4, 5, 8) else 1):  # a replayed batch folds and appends again
            if n and n % 4 == 0:
                state.fold(n, 4)
            clusters = state.clusters([busy], n, n).drop("bucket").where("account_id = 'busy'") if n else None
            state.append(leader_pass(part, 0.6, state=clusters).placed, n)
        seen.append([len(state.read(kind, [busy], n, n).inputFiles()) for kind in (MEMBER, CLUSTER)] if n else [0, 0])
    folders = [sum(map(len, state.folders(MEMBER, [busy], n + 1, n + 1))) for n in (12,)]
    assert folders[0] <= 5 and len(state.batches(99)) <= 8
    assert max(seen[-4:]) <= max(seen[5:9])  # not more files than four batches before
    got = {(r.account_id, r.ticket_id): r.cluster_id for r in streamed_members(spark, out, table).collect()}
    mine = [(r[2], r[5]) for r in rows if r[0] == "busy" and r[2] < 126]
    want = {("busy", t): c for t, c in brute.leaders(mine, 0.6).items()} | {("idle%d" % i, i): i for i in range(30)}
    assert got == want
    held = {(r.account_id, r.cluster_id): r.member_count for r in streamed_clusters(spark, out, table).collect()}
    assert held == {g: [(a, c) for (a, _), c in want.items()].count(g) for g in {(a, c) for (a, _), c in want.items()}}
    with pytest.raises(ValueError, match="has 16 buckets"):
        BucketState(spark, out, ("account_id", "run_id"), fields, 32)
