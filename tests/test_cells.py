"""The stored index over cells: exact when all cells are visited, extended without training."""

from __future__ import annotations

import numpy as np
import pytest
from test_nearest import data, expected, found, frames

from topicloom.operators.cells import CellIndex, build_index
from topicloom.operators.nearest import nearest, recall


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "index")


def contents(index: CellIndex) -> dict[tuple[str, int], list[float]]:
    rows = index.items().collect()
    out = {(r.account_id, r.item_id): r.item_vector for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 7}])
def test_all_cells_give_the_exact_result(spark, folder, options):
    queries, items = data(2)
    left, right = frames(spark, queries, items)
    assert found(build_index(right, folder, 6).search(left, 5, 100, **options)) == expected(queries, items, 5)


def test_recall_grows_with_the_share(spark, folder):
    rng = np.random.default_rng(4)
    queries = [("a", i, v) for i, v in enumerate(rng.normal(size=(50, 8)))]
    items = [("a", i, v) for i, v in enumerate(rng.normal(size=(400, 8)))]
    left, right = frames(spark, queries, items)
    index, exact = build_index(right, folder, 20), nearest(left, right, 5)
    low, high = (recall(index.search(left, 5, share), exact).first().recall for share in (5, 60))
    assert 0.2 < low < high and high >= 0.9


def test_no_query_is_left_short(spark, folder):
    rng = np.random.default_rng(6)
    queries = [(a, i, v) for a in "ab" for i, v in enumerate(rng.normal(size=(30, 8)))]
    items = [(a, i, v) for a in "ab" for i, v in enumerate(rng.normal(size=(5 if a == "a" else 60, 8)))]
    left, right = frames(spark, queries, items)
    counts = build_index(right, folder, 20).search(left, 5, 1).groupBy("account_id", "query_id").count().collect()
    assert len(counts) == 60 and {r["count"] for r in counts} == {5}


def test_appended_items_are_found_and_train_nothing(spark, folder):
    queries, items = data(3)
    left, first = frames(spark, queries, items[:40])
    index = build_index(first, folder, 6)
    before = index.centres()
    index.append(frames(spark, [], items[40:])[1], 1)
    assert all(np.array_equal(a, b) for a, b in zip(before, index.centres(), strict=True))
    assert index.batches() == [0, 1]
    assert found(index.search(left, 5, 100)) == expected(queries, items, 5)


def test_a_later_batch_replaces_and_a_repeated_batch_replaces_itself(spark, folder):
    items = [("a", i, (1.0, i)) for i in range(6)] + [("b", 1, (0.0, 1.0))]
    index = build_index(frames(spark, [], items)[1], folder, 3)
    change = frames(spark, [], [("a", 1, (-1.0, 0.0)), ("a", 9, (0.0, -1.0))])[1]
    for _ in range(2):
        index.append(change, 1)
        now = contents(index)
        assert len(now) == 8 and now["a", 1] == [-1.0, 0.0] and now["b", 1] == [0.0, 1.0]
    index.append(frames(spark, [], [("a", 1, (0.5, 0.5))])[1], 2)
    assert contents(index)["a", 1] == [0.5, 0.5] and len(contents(index)) == 8


def test_a_batch_that_was_not_finished_does_not_count(spark, folder, tmp_path):
    index = build_index(frames(spark, [], [("a", i, (1.0, i)) for i in range(4)])[1], folder, 2)
    index.append(frames(spark, [], [("a", 1, (9.0, 9.0)), ("a", 7, (1.0, 1.0))])[1], 1)
    (tmp_path / "index" / "items" / "batch=1" / "_SUCCESS").unlink()
    assert set(contents(index)) == {("a", i) for i in range(4)} and contents(index)["a", 1] == [1.0, 1.0]


def test_only_visited_cells_are_read(spark, folder, capsys):
    items = [("a", 10 * c + i, v) for c, v in enumerate([(1, 0, 0), (0, 1, 0), (0, 0, 1)]) for i in range(5)]
    left, right = frames(spark, [("a", 1, (0.9, 0.1, 0.0))], items)
    index = build_index(right, folder, 15)
    held = {(r.cell, r.rows) for r in index.rows_by_cell().collect()}
    assert sum(rows for _, rows in held) == 15
    found_ids = found(index.search(left, 5, 1, broadcast_bytes=0))["a", 1]
    assert found_ids == [0, 1, 2, 3, 4]
    index.items([0]).explain("formatted")
    filters = [line for line in capsys.readouterr().out.splitlines() if line.startswith("PartitionFilters")]
    assert len(filters) == 1 and "cell#" in filters[0] and "batch#" in filters[0]
    index.rows_by_cell().explain("formatted")
    schema = [line for line in capsys.readouterr().out.splitlines() if line.startswith("ReadSchema")]
    assert schema and not any("item_vector" in line for line in schema)


def test_the_same_rows_give_the_same_cells(spark, folder):
    items = data(5)[1]
    one = build_index(frames(spark, [], items)[1], folder + "1", 7)
    two = build_index(frames(spark, [], items[::-1])[1].repartition(5), folder + "2", 7)
    cells = [{(r.account_id, r.item_id): r.cell for r in index.items().collect()} for index in (one, two)]
    assert cells[0] == cells[1]


def test_sample_bounds_the_fit_not_the_index(spark, folder):
    queries, items = data(8)
    left, right = frames(spark, queries, items)
    index = build_index(right, folder, 4, sample_rows=30)
    assert len(contents(index)) == len(items)
    assert found(index.search(left, 5, 100)) == expected(queries, items, 5)


def test_empty_null_zero_and_unscoped(spark, folder):
    left, none = frames(spark, [("a", 1, (1, 0))], [])
    index = build_index(none, folder + "1", 3)
    assert index.search(left).collect() == []
    index.append(frames(spark, [], [("a", 5, (1, 0))])[1], 1)
    assert index.items().count() == 1
    right = spark.createDataFrame([("a", 1, None), ("a", 2, [0.0, 0.0]), (None, 3, [1.0, 0.0]), ("b", 4, [1.0, 0.1])],
                                  none.schema)
    index = build_index(right, folder + "2", 3, on=[])
    got = index.search(left, 3, 100).orderBy("rank").collect()
    assert [r.item_id for r in got] == [3, 4, 2]
    scoped = build_index(right, folder + "3", 3).search(left, 3, 100).collect()
    assert [r.item_id for r in scoped] == [2]
