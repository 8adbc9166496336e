from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import gaps as G
from topicloom.operators import labels as L
from topicloom.operators import models as M
from topicloom.operators import sizes


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def test_embedding_stage_gives_unit_vectors(spark):
    df = M.embed_texts(texts(spark, "reset my password", "", "Reset PASSWORD my"), "text",
                       M.embedder("hashing"))
    a, empty, b = (np.array(r.embedding) for r in sorted(df.collect(), key=lambda r: r.id))
    assert a.shape == (1536,) and np.linalg.norm(a) == pytest.approx(1, abs=1e-6)
    assert not empty.any()
    assert a.tolist() == b.tolist()


def fixed(rows):
    return lambda: lambda batch: np.array(rows[: len(batch)])


def test_embedding_output_is_normalized_and_checked(spark):
    df = M.embed_texts(texts(spark, "x"), "text", fixed([[3.0, 4.0]]), 2)
    assert df.first().embedding == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="returned shape"):
        M.embed_texts(texts(spark, "x"), "text", fixed([[3.0, 4.0]]), 3).collect()


def test_unknown_provider():
    with pytest.raises(ValueError, match="Unknown provider"):
        M.embedder("nobody")
    M.register_embedder("mine", lambda dimension: fixed([[1.0] * dimension]))
    assert M.embedder("mine", 2)()(["x"]).tolist() == [[1.0, 1.0]]


def parrot():
    def answer(prompt):
        assert "301-820-4477" not in prompt
        if "explode" in prompt:
            raise RuntimeError("no quota")
        if "silence" in prompt:
            return ""
        return "Label: Loud bell\nSummary: Callers hear it twice." if "[REDACTED]" in prompt else "hm"
    return answer


def test_model_labels_are_masked_and_isolated(spark):
    members = spark.createDataFrame(
        [("a", 1, c, t) for c, t in ((1, 1), (1, 2), (2, 3), (3, 4), (4, 5))],
        "account_id string, run_id int, cluster_id int, ticket_id int")
    tickets = spark.createDataFrame(
        [("a", 1, "s", "ring 301-820-4477, please"), ("a", 2, None, "x"),
         ("a", 3, "explode", None), ("a", 4, "silence", ""), ("a", 5, "plain", "y")],
        "account_id string, ticket_id int, subject string, description string")
    masked = L.excerpts(L.representatives(members), tickets)
    first = {r.cluster_id: r.masked_excerpts for r in masked.collect()}[1]
    assert first == ("Ticket 1:\nSubject: s\nDescription: ring [REDACTED], please\n\n"
                     "Ticket 2:\nSubject: (none)\nDescription: x")
    got = {r.cluster_id: (r.label, r.summary, r.error) for r in L.label_by_model(masked, parrot).collect()}
    assert got == {1: ("Loud bell", "Callers hear it twice.", None), 2: ("Unlabeled cluster", "", "no quota"),
                   3: ("Unlabeled cluster", "", "provider returned no text"),
                   4: ("Unlabeled topic", "", None)}


def test_first_five_representatives(spark):
    members = spark.createDataFrame([("a", 1, 1, t) for t in range(20, 0, -1)],
                                    "account_id string, run_id int, cluster_id int, ticket_id int")
    assert [r.ticket_id for r in L.representatives(members).orderBy("position").collect()] == [1, 2, 3, 4, 5]


def test_keywords_prefer_words_of_one_cluster(spark):
    df = spark.createDataFrame(
        [("a", 1, 1, "refund refund the invoice"), ("a", 1, 2, "the password the reset the the")],
        "account_id string, run_id int, cluster_id int, text string")
    scores = L.term_scores(df, df.select(*L.CLUSTER))
    best = {r.cluster_id: r.term for r in L.keywords(scores, 1).collect()}
    assert best == {1: "refund", 2: "the"}
    labels = {r.cluster_id: r.label for r in L.extractive_labels(scores).collect()}
    assert labels[1] == "refund invoice the"


def topics(spark):
    d = datetime
    return spark.createDataFrame(
        [("a", 1, 1, 10, None, None), ("a", 1, 2, 8, 0.9, d(2026, 1, 1)), ("a", 1, 3, 6, 0.5, d(2026, 1, 1)),
         ("a", 1, 4, 4, 0.1, d(2020, 1, 1)), ("a", 1, 5, 20, 0.1, d(2026, 1, 1))],
        "account_id string, run_id int, cluster_id int, ticket_count int, distance double, updated_at timestamp")


def test_gap_reports(spark):
    gaps = G.classify_gaps(topics(spark), 0.7, 0.4, datetime(2025, 1, 1))
    assert {r.cluster_id: r.classification for r in gaps.collect()} == {
        1: "missing", 2: "missing", 3: "weak", 4: "outdated", 5: "good_coverage"}
    assert {r.classification: (r.topics, r.ticket_volume) for r in G.gap_volume(gaps).collect()} == {
        "missing": (2, 18), "weak": (1, 6), "outdated": (1, 4), "good_coverage": (1, 20)}
    scores = {r.cluster_id: r.priority_score for r in G.prioritize(gaps).collect()}
    assert scores == pytest.approx({1: 10.0, 2: 8.0, 3: 3.0, 4: 2.8, 5: 0.0})
    lists = G.dashboard_lists(gaps, 2).collect()
    by_list = {}
    for r in sorted(lists, key=lambda r: r.position):
        by_list.setdefault(r.list, []).append(r.cluster_id)
    assert by_list == {"top_missing": [1, 2], "most_repeated": [5, 1], "needs_update": [3, 4]}
    with pytest.raises(ValueError):
        G.classify_gaps(topics(spark), 0.3, 0.4, datetime(2025, 1, 1))


def test_review_funnel(spark):
    drafts = spark.createDataFrame([("a", "approved"), ("a", "approved"), ("a", "published"), ("b", "rejected")],
                                   "account_id string, review_status string")
    got = {r.account_id: r.asDict() for r in G.review_funnel(drafts).collect()}
    assert got["a"] == {"account_id": "a", "pending_review": 0, "approved": 2, "rejected": 0, "published": 1}


def test_best_words_are_found_by_small_tasks(spark, monkeypatch):
    """A fixed number of tasks (four here) would each hold more, the larger the tables are."""
    monkeypatch.setattr(sizes, "SMALL_TASK_BYTES", 1 << 13)
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    scores = spark.range(20_000).selectExpr(
        "'a' AS account_id", "1L AS run_id", "id % 500 AS cluster_id", "cast(id AS string) AS term",
        "cast(id AS double) AS score")
    settings = [spark.conf.get(key, None) for key in (sizes.ADVISORY_BYTES, sizes.INITIAL_PARTS)]
    spark.conf.set(least, "1")
    try:
        best = L.keywords(scores, 5)
    finally:
        spark.conf.unset(least)
    assert settings == [spark.conf.get(key, None) for key in (sizes.ADVISORY_BYTES, sizes.INITIAL_PARTS)]
    assert best.select(F.input_file_name()).distinct().count() > 4
    got = {(r.cluster_id, r["rank"]): r.term for r in best.collect()}
    assert got == {(c, r): str(20_000 - 500 * r + c) for c in range(500) for r in range(1, 6)}
