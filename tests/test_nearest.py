from __future__ import annotations

import tracemalloc

import brute
import numpy as np
import pytest

from topicloom.operators.nearest import BROADCAST_BYTES, _top_k, assign_to_centroids, nearest

Q = "account_id string, query_id long, query_vector array<double>"
I = "account_id string, item_id long, item_vector array<double>"


def frames(spark, queries, items):
    left = spark.createDataFrame([(a, i, [float(x) for x in v]) for a, i, v in queries], Q)
    right = spark.createDataFrame([(a, i, [float(x) for x in v]) for a, i, v in items], I)
    return left, right


def found(df) -> dict[tuple[str, int], list[int]]:
    out: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in df.collect():
        out.setdefault((r.account_id, r.query_id), []).append((r.rank, r.item_id))
    return {key: [i for _, i in sorted(pairs)] for key, pairs in out.items()}


def data(seed=1):
    rng = np.random.default_rng(seed)
    # One account holds most of both sides.
    queries = [("big" if i % 8 else "small", i, v) for i, v in enumerate(rng.normal(size=(60, 7)))]
    items = [("big" if i % 6 else "small", i, v) for i, v in enumerate(rng.normal(size=(90, 7)))]
    return queries, items


def expected(queries, items, k):
    out = {}
    for account in {a for a, _, _ in queries}:
        best = brute.nearest({i: v for a, i, v in queries if a == account},
                             {i: v for a, i, v in items if a == account}, k)
        out.update({(account, q): ids for q, ids in best.items()})
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "block_rows": 7}])
@pytest.mark.parametrize("k", [1, 5, 200])
def test_exact_search_equals_brute_force(spark, options, k):
    queries, items = data()
    got = found(nearest(*frames(spark, queries, items), k, **options))
    assert got == expected(queries, items, k)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 2}])
def test_ties_and_zero_vectors(spark, options):
    queries = [("a", 1, (1, 0)), ("a", 2, (0, 0)), ("b", 3, (1, 0))]
    items = [("a", 9, (2, 0)), ("a", 4, (5, 0)), ("a", 6, (0, 0)), ("a", 5, (1, 0))]
    df = nearest(*frames(spark, queries, items), 3, **options)
    assert found(df) == {("a", 1): [4, 5, 9], ("a", 2): [4, 5, 6]}
    assert {r.distance for r in df.filter("query_id = 2").collect()} == {1.0}


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_scopes_of_two_columns_and_nulls(spark, options):
    """A null scope matches nothing, as in a join."""
    queries = [("a", 1, 1, [1.0, 0.0]), ("a", 2, 2, [1.0, 0.0]), (None, 1, 3, [1.0, 0.0])]
    items = [("a", 1, 7, [0.0, 1.0]), ("a", 2, 8, [1.0, 0.0]), ("b", 1, 9, [1.0, 0.0]), (None, 1, 6, [1.0, 0.0])]
    left = spark.createDataFrame(queries, "account_id string, run_id int, query_id long, query_vector array<double>")
    right = spark.createDataFrame(items, "account_id string, run_id int, item_id long, item_vector array<double>")
    got = nearest(left, right, 2, ["account_id", "run_id"], **options).collect()
    assert sorted((r.query_id, r.item_id) for r in got) == [(1, 7), (2, 8)]


def test_ids_may_repeat_across_accounts(spark):
    queries = [(a, 1, v) for a, v in (("a", (1, 0)), ("b", (0, 1)))]
    items = [(a, i, v) for a in "ab" for i, v in enumerate([(1, 0), (0, 1), (1, 1)])]
    both = frames(spark, queries, items)
    want = {("a", 1): [0, 2, 1], ("b", 1): [1, 2, 0]}
    assert found(nearest(*both, 3)) == want


def test_assignment(spark):
    rows = spark.createDataFrame(
        [("a", 1, 1, [1.0, 0.0]), ("a", 1, 2, [0.0, 1.0]), ("b", 1, 3, [1.0, 0.0])],
        "account_id string, run_id long, ticket_id long, embedding array<double>")
    centers = spark.createDataFrame(
        [("a", 1, 10, [2.0, 0.0]), ("a", 1, 11, [-1.0, 0.1])],
        "account_id string, run_id long, cluster_id long, centroid array<double>")
    got = {r.ticket_id: (r.cluster_id, round(r.similarity, 6))
           for r in assign_to_centroids(rows, centers, 0.7).collect()}
    assert got == {1: (10, 1.0), 2: (None, 0.099504), 3: (None, -1.0)}


def test_mixed_lengths_are_an_error(spark):
    left, right = frames(spark, [("a", 1, (1, 0))], [("a", 1, (1, 0, 0))])
    with pytest.raises(Exception, match="vectors differ in length"):
        nearest(left, right, 1).collect()


def test_a_block_holds_few_distances_at_a_time():
    """Every Python worker of an executor does this at once, beside its copy of the items."""
    rng = np.random.default_rng(2)
    queries, items = rng.normal(size=(3000, 8)), rng.normal(size=(4000, 8))
    tracemalloc.start()
    found = [(rows, cols) for rows, cols, _ in _top_k(queries, items, 5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and BROADCAST_BYTES <= 16 << 20
    best = np.argsort(1 - queries @ items.T, axis=1, kind="stable")[:, :5]
    assert np.concatenate([cols for _, cols in found]).reshape(-1, 5).tolist() == best.tolist()
