"""Approximate nearest neighbours in learned partitions.

*Fit*, on a bounded sample (``SAMPLE_ROWS``, picked by a hash of the id) on the driver:
the exact neighbour graph of the sample is cut into partitions of equal size, by moving
nodes to the partition most of their neighbours are in as far as it has room; then a
softmax classifier with one hidden layer learns the partition of a vector.

*Index.* Every vector goes to its most probable partition, in Arrow batches. Nothing is
dropped; a large partition is cut into blocks of at most ``BLOCK_ROWS`` rows.

*Search.* A query is routed to its most probable partitions: as many as sample rows
kept out of the training need for ``TARGET_RECALL`` of their neighbours, and more until
they hold ``k`` candidates. Blocks of vectors meet blocks of the queries of their
partition in one task each, which ranks them exactly, in double precision, and returns
the best ``k`` ids of each query; the best of all blocks win, ties by smaller id. All
rows that are as near as the last of these are ranked, however many.

On vectors without structure no partitioning helps, and most partitions are visited.

Vectors that are null or zero, or hold null or non-finite components, take no part, nor
do vectors without an id or of another length than most. Rows with an id seen twice
count once for each query, at the smaller distance; a query meets no row of its own
id. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.llm.common import saved

SAMPLE_ROWS = 12_000
PARTITION_ROWS, MAX_PARTITIONS = 400, 256
BLOCK_ROWS, QUERY_ROWS = 50_000, 50_000
GRAPH_NEIGHBOURS, HIDDEN = 10, 96
TARGET_RECALL = 0.95


@dataclass
class Router:
    """Classifier from vectors to partitions."""

    mean: np.ndarray
    scale: float
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) * self.scale @ self.first + self.first_bias, 0)
        return hidden @ self.second + self.second_bias


def usable(vector: Column, length: int) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == length) & ~bad & F.exists(vector, lambda v: v != 0)


def _stacked(column: pa.Array, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` nearest other rows of each row."""
    k = min(k, len(x) - 1)
    norms = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        some = slice(at, at + 1024)
        distance = norms[None] - 2 * x[some] @ x.T
        distance[np.arange(len(distance)), np.arange(at, at + len(distance))] = np.inf
        out[some] = np.argpartition(distance, k - 1, axis=1)[:, :k] if k else out[some]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, *, rounds: int = 12, slack: float = 1.1,
                       seed: int = 5) -> np.ndarray:
    """Partition of each node: cut by halves along main directions, then nodes move to
    where most of their neighbours are while there is room."""
    rng = np.random.default_rng(seed)
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, base, count = todo.pop()
        if count == 1:
            label[rows] = base
            continue
        centred = x[rows] - x[rows].mean(0)
        direction = rng.normal(size=x.shape[1])
        for _ in range(8):
            direction = centred.T @ (centred @ direction)
            direction /= np.linalg.norm(direction) + 1e-12
        order = rows[np.argsort(centred @ direction, kind="stable")]
        cut = len(rows) * (count // 2) // count
        todo += [(order[:cut], base, count // 2), (order[cut:], base + count // 2, count - count // 2)]
    room = int(np.ceil(slack * len(x) / parts))
    both = [np.concatenate([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])]),
            np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])]
    for _ in range(rounds):
        votes = np.bincount(both[1] * parts + label[both[0]], minlength=len(x) * parts).reshape(len(x), parts)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        sizes = np.bincount(label, minlength=parts)
        movers = np.flatnonzero(gain > 0)
        for node in movers[np.argsort(-gain[movers], kind="stable")]:
            if sizes[best[node]] < room:
                sizes[label[node]] -= 1
                sizes[best[node]] += 1
                label[node] = best[node]
    return label


def train_router(x: np.ndarray, label: np.ndarray, parts: int, *, epochs: int = 12, seed: int = 6) -> Router:
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), float(1 / max(x.std(), 1e-12))
    data = ((x - mean) * scale).astype(np.float32)
    params = [p.astype(np.float32) for p in (
        rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(data), 128):
            rows = order[at : at + 128]
            pre = data[rows] @ params[0] + params[1]
            hidden = np.maximum(pre, 0)
            logits = hidden @ params[2] + params[3]
            error = np.exp(logits - logits.max(1, keepdims=True))
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(rows)), label[rows]] -= 1
            error /= len(rows)
            back = (error @ params[2].T) * (pre > 0)
            step += 1
            for p, (m, v), g in zip(params, moments, [data[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(0)],
                                    strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Router(mean, scale, *params)


def fit(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
        sample_rows: int = SAMPLE_ROWS, partition_rows: int = PARTITION_ROWS) -> tuple[Router | None, int, int]:
    """Router, number of partitions, length of vectors."""
    lengths = (vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
               .groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").first())
    length = int(lengths["n"]) if lengths else 0
    if not length:
        return None, 0, length
    good = vectors.where(usable(F.col(vector_col), length) & F.col(id_col).isNotNull())
    rows = good.select(F.xxhash64(id_col).alias("_h"), F.col(id_col).alias("_id"), F.col(vector_col).alias("v"))
    total = rows.count()
    if not total:
        return None, 0, length
    # A share of the hash range that holds the sample, then its exact size.
    share = min(1.0, 1.2 * sample_rows / total)
    some = rows.where(F.pmod("_h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("_h", "_id").limit(sample_rows)
    x = _stacked(some.select("v").toArrow().column(0), length)
    parts = int(np.clip(total // partition_rows, 1, min(MAX_PARTITIONS, max(1, len(x) // 32))))
    if parts == 1:
        return None, 1, length
    graph = neighbour_graph(x, GRAPH_NEIGHBOURS)
    taught = np.arange(len(x)) % 5 != 0
    router = train_router(x[taught], balanced_partition(x, graph, parts)[taught], parts)
    router.probes = needed_probes(router, x, graph, ~taught)
    return router, parts, length


def needed_probes(router: Router, x: np.ndarray, graph: np.ndarray, asked: np.ndarray,
                  recall: float = TARGET_RECALL) -> int:
    """Partitions a query has to visit to meet so many of its neighbours, by rows of the
    sample that the router was not trained on."""
    scores = router.scores(x)
    order = np.argsort(-scores[asked], axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
    visited = np.sort(np.take_along_axis(place, scores.argmax(1)[graph[asked]], 1).ravel())
    return int(visited[min(len(visited) - 1, int(np.ceil(recall * len(visited))))]) + 1


def indexed(vectors: DataFrame, router: Router | None, length: int, *, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """Every usable vector as ``id, v`` and its ``part``; stored."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stacked(batch.column(1), length)
            part = router.scores(x).argmax(1) if router else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part.astype(np.int32))],
                                             ["id", "v", "part"])

    good = vectors.where(usable(F.col(vector_col), length) & F.col(id_col).isNotNull())
    narrow = good.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return saved(narrow.mapInArrow(place, "id bigint, v array<double>, part int"), "indexed")


def search(index: DataFrame, queries: DataFrame, router: Router | None, parts: int, length: int, *,
           k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``queries`` (``id, v``)."""
    counts = np.zeros(max(parts, 1), np.int64)
    for row in index.groupBy("part").count().collect():
        counts[row["part"]] = row["count"]
    blocks = np.maximum(1, -(-counts // BLOCK_ROWS))
    # Different ids, each in one of its partitions: no more than that are sure to be met.
    different = np.zeros_like(counts)
    for row in index.groupBy("id").agg(F.min("part").alias("part")).groupBy("part").count().collect():
        different[row["part"]] = row["count"]
    least = router.probes if router else 1
    query_blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stacked(batch.column(1), length)
            ids = np.asarray(batch.column(0))
            order = np.argsort(-router.scores(x), axis=1, kind="stable") if router else np.zeros((len(x), 1), np.int64)
            # Its own id may be among the first: room for it.
            enough = np.cumsum(different[order], axis=1) - different[order] < k + 1
            enough[:, :least] = True
            row, at = np.nonzero(enough)
            part = order[row, at]
            each = blocks[part]
            row, part = np.repeat(row, each), np.repeat(part, each)
            block = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(ids[row]),
                 batch.column(1).take(pa.array(row))], ["part", "block", "id", "v"])

    def rank(key: tuple, items: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(items) or not len(asked):
            return _found(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        x, ids = _stacked(items.column("v"), length), items.column("id").to_numpy()
        x, ids = _first_of_copies(x, ids, k + 1)
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        norms = (x * x).sum(1)
        reach = np.sqrt(norms.max())
        out = []
        for at in range(0, len(asked), 256):
            some = asked.slice(at, 256)
            q, own = _stacked(some.column("v"), length), some.column("id").to_numpy()
            rough = norms[None] - 2 * q @ x.T
            rough[own[:, None] == ids[None]] = np.inf
            # An id counts once, at its nearest row.
            by_id = np.minimum.reduceat(rough, starts, axis=1) if len(starts) < len(ids) else rough
            last = min(by_id.shape[1], k) - 1
            limit = np.partition(by_id, last, axis=1)[:, last]
            # Rounding of the rough distance, of either side: whoever may be among the best k stays.
            limit = limit + 8 * (length + 4) * np.finfo(float).eps * (reach + np.sqrt((q * q).sum(1))) ** 2
            for one, (row, bound) in enumerate(zip(rough, limit)):
                near = np.flatnonzero((row <= bound) & np.isfinite(row))
                exact = _distances(x, near, q[one])
                best = np.lexsort((ids[near], exact))
                _, first = np.unique(ids[near][best], return_index=True)
                best = best[np.sort(first)[:k]]
                out.append((np.full(len(best), own[one]), ids[near][best], exact[best]))
        return _found(*(np.concatenate(c) for c in zip(*out)))

    chunk = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    of_part = F.get(F.array(*[F.lit(int(b)) for b in blocks]), F.col("part"))
    items = index.withColumns({"block": chunk(of_part), "asked": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))})
    asked = queries.select("id", "v").mapInArrow(route, "part int, block int, id bigint, v array<double>")
    asked = asked.withColumn("asked", chunk(F.lit(query_blocks)))
    found = (items.groupBy("part", "block", "asked").cogroup(asked.groupBy("part", "block", "asked"))
             .applyInArrow(rank, "query_id bigint, vec_id bigint, score double"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _first_of_copies(x: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id, without those that no query can have among its best: repeats, and equal
    vectors with larger ids than ``count`` others."""
    _, kind = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, kind))
    new = np.r_[True, (kind[order][1:] != kind[order][:-1]) | (ids[order][1:] != ids[order][:-1])]
    order = order[new]
    first = np.flatnonzero(np.r_[True, kind[order][1:] != kind[order][:-1]])
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    order = order[place < count]
    order = order[np.argsort(ids[order], kind="stable")]
    return x[order], ids[order]


def _distances(x: np.ndarray, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Distances of some rows, a bounded number at a time. Rows that are equal get equal ones."""
    return np.concatenate([np.empty(0), *(np.sqrt(((x[rows[at : at + 4096]] - query) ** 2).sum(1))
                                          for at in range(0, len(rows), 4096))])


def _found(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(queries, pa.int64()), "vec_id": pa.array(ids, pa.int64()),
                     "score": pa.array(scores, pa.float64())})


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding",
            k: int = 10, sample_rows: int = SAMPLE_ROWS,
            partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Nearest rows of a table for those of its rows that ``is_query`` (over ``id``)."""
    router, parts, length = fit(vectors, id_col=id_col, vector_col=vector_col, sample_rows=sample_rows,
                                partition_rows=partition_rows)
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = indexed(vectors, router, length, id_col=id_col, vector_col=vector_col)
    return search(index, index.where(is_query), router, parts, length, k=k)
