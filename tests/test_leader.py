from __future__ import annotations

import brute
import numpy as np
import pytest

from topicloom.operators import leader
from topicloom.operators.leader import LeaderPass, leader_pass, running_sums, split_by_size

SCHEMA = "account_id string, run_id long, ticket_id long, embedding array<double>"


def frame(spark, groups: dict[str, list[tuple[int, list[float]]]]):
    rows = [(g, 1, i, [float(x) for x in v]) for g, items in groups.items() for i, v in items]
    return spark.createDataFrame(rows, SCHEMA)


def placed(result: LeaderPass) -> dict[str, dict[int, int]]:
    out: dict[str, dict[int, int]] = {}
    for r in result.members.collect():
        assert r.ticket_id not in out.setdefault(r.account_id, {})
        out[r.account_id][r.ticket_id] = r.cluster_id
    return out


CASES = [
    ([(1, (1, 0, 0)), (2, (.99, .01, 0)), (3, (.98, .02, 0))], .9, 2, {1: 1, 2: 1, 3: 1}),
    ([(1, (1, 0, 0)), (2, (.99, .01, 0)), (3, (0, 1, 0)), (4, (.01, .99, 0))], .9, 2, {1: 1, 2: 1, 3: 3, 4: 3}),
    ([(1, (1, 0, 0)), (2, (.99, .01, 0)), (3, (0, 0, 1))], .9, 2, {1: 1, 2: 1, 3: None}),
    ([(1, (1, 0, 0)), (2, (.7, .3, 0))], .99, 1, {1: 1, 2: 2}),
    ([(1, (1, 0, 0)), (2, (.7, .3, 0))], .7, 1, {1: 1, 2: 1}),
    ([(1, (1, 0)), (2, (0, 0)), (3, (0, 0))], .5, 1, {1: 1, 2: 2, 3: 3}),
]


@pytest.mark.parametrize("rows,threshold,min_size,expected", CASES)
def test_cases(spark, rows, threshold, min_size, expected):
    result = leader_pass(frame(spark, {"a": rows}), threshold)
    split = split_by_size(result.members, min_size).collect()
    assert {r.ticket_id: r.cluster_id for r in split} == expected
    assert all(r.is_clustered == (r.cluster_id is not None) for r in split)


def test_empty_input(spark):
    assert placed(leader_pass(frame(spark, {}), .8)) == {}


def test_full_dimension(spark):
    a = [0.1] * 1536
    b = [x + 0.001 for x in a]
    c = [1.0] + [0.0] * 1535
    df = frame(spark, {"a": [(1, a), (2, b), (3, c)]})
    for _ in range(2):
        assert placed(leader_pass(df, .9)) == {"a": {1: 1, 2: 1, 3: 3}}


def test_rows_without_vector_are_left_out(spark):
    df = spark.createDataFrame([("a", 1, 1, [1.0, 0.0]), ("a", 1, 2, None)], SCHEMA)
    assert placed(leader_pass(df, .5)) == {"a": {1: 1}}


def test_ties_go_to_the_earliest_cluster(spark):
    rows = [(1, (1, 0, 1)), (2, (1, 0, -1)), (3, (1, 0, 0))]
    assert placed(leader_pass(frame(spark, {"a": rows}), .7)) == {"a": {1: 1, 2: 2, 3: 1}}


@pytest.mark.parametrize("chunk_rows,lookahead", [(1, 4), (7, 1), (13, 5), (60, 8)])
def test_rounds_equal_the_sequential_pass(spark, chunk_rows, lookahead):
    """Unstructured vectors: nearly every guess is wrong, the outcome is not."""
    rng = np.random.default_rng(11)
    count = 9 if chunk_rows == 1 else 90
    groups = {"hot": [(i, v) for i, v in enumerate(rng.normal(size=(count, 6)))],
              "cool": [(1000 + i, v) for i, v in enumerate(rng.normal(size=(5, 6)))]}
    result = leader_pass(frame(spark, groups), .5, chunk_rows=chunk_rows, lookahead=lookahead)
    assert placed(result) == {g: brute.leaders(rows, .5) for g, rows in groups.items()}


def test_cutting_changes_no_tie(spark):
    """Mirrored clusters and rows in the middle: any other last bit would move them."""
    rng, groups = np.random.default_rng(3), {}
    for trial in range(60):
        half = np.abs(rng.normal(size=(4, 3))) + [1.0, 0.3, 0.0]
        both = [v * m for v in half for m in ((1, 1, 1), (1, -1, 1))]
        order = rng.permutation(len(both))
        rows = [both[k] for k in order] + [np.array([1.0, 0.0, rng.normal()]) for _ in range(3)]
        groups[f"g{trial}"] = list(enumerate(rows))
    df = frame(spark, groups)
    whole = placed(leader_pass(df, .9))
    for chunk_rows in (2, 3, 7, 3):
        assert placed(leader_pass(df, .9, chunk_rows=chunk_rows, lookahead=4)) == whole
    first = leader_pass(df.filter("ticket_id < 5"), .9)
    rest = placed(leader_pass(df.filter("ticket_id >= 5"), .9, state=first.clusters))
    assert {g: {**placed(first)[g], **rest[g]} for g in whole} == whole


def test_starts_have_one_row_for_a_cluster_and_step(spark):
    parts = spark.createDataFrame(
        [("a", 1, [1.0, 0.0], 1, -1), ("a", 1, [0.5, 1.0], 2, 1), ("a", 2, [0.0, 1.0], 1, 0), ("a", 1, [1.0, 1.0], 1, 1)],
        "account_id string, cluster_id long, vector_sum array<double>, member_count long, source_step long")
    got = {(r.cluster_id, r.step): (r.vector_sum, r.member_count) for r in running_sums(parts, ["account_id"], 4).collect()}
    assert got == {(1, 0): ([1.0, 0.0], 1), (1, 1): ([1.0, 0.0], 1), (1, 2): ([2.5, 2.0], 4), (1, 3): ([2.5, 2.0], 4),
                   (2, 1): ([0.0, 1.0], 1), (2, 2): ([0.0, 1.0], 1), (2, 3): ([0.0, 1.0], 1)}


def test_one_group_with_most_rows_and_real_topics(spark):
    vectors = brute.planted(8, 600, 16, 0.25, seed=5)
    groups = {"hot": list(enumerate(vectors[:450])),
              "warm": [(i + 1000, v) for i, v in enumerate(vectors[450:560])],
              "cool": [(i + 2000, v) for i, v in enumerate(vectors[560:])]}
    result = leader_pass(frame(spark, groups), .7, chunk_rows=50, lookahead=8)
    assert placed(result) == {g: brute.leaders(rows, .7) for g, rows in groups.items()}
    sums = {(r.account_id, r.cluster_id): (r.vector_sum, r.member_count) for r in result.clusters.collect()}
    for name, rows in groups.items():
        vector_of = dict(rows)
        members: dict[int, list[int]] = {}
        for ticket, cluster in brute.leaders(rows, .7).items():
            members.setdefault(cluster, []).append(ticket)
        for cluster, tickets in members.items():
            total, count = sums.pop((name, cluster))
            assert count == len(tickets)
            assert total == pytest.approx(np.sum([vector_of[t] for t in tickets], axis=0).tolist())
    assert not sums


@pytest.mark.parametrize("chunk_rows", [4096, 20])
def test_state_continues_an_earlier_pass(spark, chunk_rows):
    vectors = brute.planted(5, 120, 8, 0.3, seed=9)
    rows = list(enumerate(vectors))
    whole = {"a": brute.leaders(rows, .6), "idle": {5000: 5000}}
    first = leader_pass(frame(spark, {"a": rows[:70], "idle": [(5000, vectors[0])]}), .6,
                        chunk_rows=chunk_rows)
    second = leader_pass(frame(spark, {"a": rows[70:]}), .6, state=first.clusters, chunk_rows=chunk_rows)
    both = placed(first)
    both["a"].update(placed(second)["a"])
    assert both == whole
    counts = {(r.account_id, r.cluster_id): r.member_count for r in second.clusters.collect()}
    expected: dict[tuple[str, int], int] = {}
    for name, members in whole.items():
        for cluster in members.values():
            expected[name, cluster] = expected.get((name, cluster), 0) + 1
    assert counts == expected


def test_mixed_lengths_are_an_error(spark):
    with pytest.raises(Exception, match="vectors differ in length"):
        leader_pass(frame(spark, {"a": [(1, (1, 0)), (2, (1, 0, 0))]}), .5).members.collect()


def test_chunks_follow_groups_across_batches(spark):
    """Groups of uneven size, many of them hot, cut while streaming in small batches."""
    rng = np.random.default_rng(8)
    groups, at = {}, 0
    for name, size in zip("abcde", (25, 10, 11, 3, 40), strict=True):
        groups[name] = [(at + i, v) for i, v in enumerate(rng.normal(size=(size, 4)))]
        at += size
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        result = placed(leader_pass(frame(spark, groups), .6, chunk_rows=10))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert result == {g: brute.leaders(rows, .6) for g, rows in groups.items()}


def test_larger_groups_have_longer_chunks_not_more(spark, monkeypatch):
    assert [leader.rows_of_a_chunk(most, 200) for most in (201, 6400, 64_000, 10_000_000)] == [200, 200, 2000, 16384]
    assert leader.rows_of_a_chunk(10_000_000, 50_000) == 50_000
    seen, settle = [], leader._Rounds._settle
    monkeypatch.setattr(leader._Rounds, "_settle", lambda self, a, b: seen.append(b) or settle(self, a, b))
    rows = list(enumerate(brute.planted(6, 700, 8, 0.25, seed=4)))
    result = leader_pass(frame(spark, {"hot": rows}), .7, chunk_rows=2)
    assert placed(result) == {"hot": brute.leaders(rows, .7)}
    assert max(seen) <= 2 * leader.CHUNKS_OF_A_GROUP  # 350 chunks of two rows before
