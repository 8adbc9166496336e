"""Exact nearest neighbours by cosine distance.

Exact search compares every query with every item of its scope; that is what
exactness in many dimensions takes. It is done as matrix products on bounded
blocks, and only each query's best ``k`` per block leave a task, never the
pairs. Items below a checked size travel to the tasks once and the queries are
not shuffled at all; above it both sides are laid out on a grid of blocks
(fragment-and-replicate join), so that neither a hot scope nor a large item
table lands in one task.

Distances equal at nine decimals count as ties and go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from topicloom.functions.arrow import constant, matrix

DEFAULT_K = 5
# A copy is held by every Python worker of an executor, and once more while it is read.
BROADCAST_BYTES = 16 << 20
BLOCK_ROWS = 4096
TIE_DECIMALS = 9
# Distances that a task works on at a time; it holds four arrays of that size.
_CELLS_AT_ONCE = 1_000_000


def unit_rows(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = matrix(vectors)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _top_k(queries: np.ndarray, items: np.ndarray, k: int):
    """(query row, item row, distance) of the best ``k`` items; items by id."""
    if queries.shape[1] != items.shape[1]:
        raise ValueError(f"vectors differ in length: {queries.shape[1]} and {items.shape[1]}")
    k = min(k, len(items))
    slice_rows = max(1, _CELLS_AT_ONCE // len(items))
    for begin in range(0, len(queries), slice_rows):
        exact = 1.0 - queries[begin:begin + slice_rows] @ items.T
        coarse = np.round(exact, TIE_DECIMALS)
        bound = np.partition(coarse, k - 1, axis=1)[:, k - 1:k]
        rows, cols = np.nonzero(coarse <= bound)
        order = np.lexsort((cols, coarse[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        first = np.searchsorted(rows, rows, side="left")
        keep = np.arange(len(rows)) - first < k
        rows, cols = rows[keep], cols[keep]
        yield rows + begin, cols, exact[rows, cols]


def _item_block(items: pa.Table) -> tuple[pa.Array, np.ndarray]:
    items = items.sort_by("item_id")
    return items["item_id"].combine_chunks(), unit_rows(items["item_vector"])


def _pairs(queries: pa.Table, block: tuple[pa.Array, np.ndarray], k: int,
           scope: dict[str, object], schema: pa.Schema) -> Iterator[pa.Table]:
    item_ids, items = block
    for rows, cols, distance in _top_k(unit_rows(queries["query_vector"]), items, k):
        found = {name: constant(value, len(rows), schema.field(name).type)
                 for name, value in scope.items()}
        found["query_id"] = queries["query_id"].take(rows)
        found["item_id"] = item_ids.take(pa.array(cols))
        found["distance"] = distance
        yield pa.table(found).select(schema.names).cast(schema)


def by_scope(rows: pa.Table, on: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of each scope; nulls never match, as in an equi-join."""
    for name in on:
        rows = rows.filter(pc.is_valid(rows[name]))
    if not on:
        yield (), rows
    elif len(rows):
        codes = [rows[name].combine_chunks().dictionary_encode().indices.to_numpy() for name in on]
        order = np.lexsort(codes)
        changed = np.zeros(len(rows) - 1, dtype=bool)
        for code in codes:
            changed |= code[order][1:] != code[order][:-1]
        bounds = np.r_[0, np.flatnonzero(changed) + 1, len(rows)]
        sorted_rows = rows.take(order)
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            part = sorted_rows.slice(begin, end - begin)
            yield tuple(part[name][0].as_py() for name in on), part


def _result_schema(queries: DataFrame, items: DataFrame, on: Sequence[str]) -> T.StructType:
    fields = [queries.schema[key] for key in on]
    fields += [queries.schema["query_id"], items.schema["item_id"],
               T.StructField("distance", T.DoubleType())]
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields])


def best_per_query(pairs: DataFrame, k: int, on: Sequence[str]) -> DataFrame:
    """Keep each query's best ``k``; ranks are cut before and after the shuffle."""
    order = Window.partitionBy(*on, "query_id").orderBy(
        F.round("distance", TIE_DECIMALS), "item_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int = DEFAULT_K,
    on: Sequence[str] = ("account_id",),
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    item_id: str = "item_id",
    item_vector: str = "item_vector",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest items of every query within the same ``on`` scope.

    Returns ``on``, query_id, item_id, distance, rank.
    """
    on = list(on)
    queries = queries.filter(F.col(query_vector).isNotNull()).select(
        *on, F.col(query_id).alias("query_id"), F.col(query_vector).alias("query_vector"))
    items = items.filter(F.col(item_vector).isNotNull()).select(
        *on, F.col(item_id).alias("item_id"), F.col(item_vector).alias("item_vector"))
    if _bytes_of(items) <= broadcast_bytes:
        pairs = _against_broadcast(queries, items, k, on)
    else:
        pairs = _on_grid(queries, items, k, on, block_rows)
    return best_per_query(pairs, k, on)


def _bytes_of(items: DataFrame) -> int:
    entries = items.agg(F.sum(F.size("item_vector").cast("long")), F.count(F.lit(1))).first()
    return 8 * ((entries[0] or 0) + (entries[1] or 0))


def _against_broadcast(queries: DataFrame, items: DataFrame, k: int, on: list[str]) -> DataFrame:
    """Items are known to be small: one copy per executor, no shuffle of queries."""
    blocks = {key: _item_block(rows) for key, rows in by_scope(items.toArrow(), on)}
    shared = queries.sparkSession.sparkContext.broadcast(blocks)
    schema = _result_schema(queries, items, on)
    arrow_schema = to_arrow_schema(schema)

    def search(batches):
        for batch in batches:
            for key, rows in by_scope(pa.Table.from_batches([batch]), on):
                block = shared.value.get(key)
                if block is not None:
                    scope = dict(zip(on, key, strict=True))
                    for found in _pairs(rows, block, k, scope, arrow_schema):
                        yield from found.to_batches()

    return queries.mapInArrow(search, schema)


def _block_counts(df: DataFrame, on: list[str], block_rows: int, name: str) -> DataFrame:
    sizes = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.select(*on, F.ceil(F.col("_rows") / block_rows).cast("int").alias(name))


def _on_grid(queries: DataFrame, items: DataFrame, k: int, on: list[str], block_rows: int) -> DataFrame:
    """Blocks of both sides meet once each; every task sees two bounded blocks."""
    scope = on or ["_all"]
    if not on:
        queries = queries.withColumn("_all", F.lit(1))
        items = items.withColumn("_all", F.lit(1))
    grid = _block_counts(queries, scope, block_rows, "_query_blocks").join(
        _block_counts(items, scope, block_rows, "_item_blocks"), scope)

    def block_of(id_col: str, count: str):
        return F.pmod(F.xxhash64(id_col), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = (queries.join(grid, scope)
            .withColumn("_qb", block_of("query_id", "_query_blocks"))
            .withColumn("_ib", every("_item_blocks")).drop("_query_blocks", "_item_blocks"))
    right = (items.join(grid, scope)
             .withColumn("_ib", block_of("item_id", "_item_blocks"))
             .withColumn("_qb", every("_query_blocks")).drop("_query_blocks", "_item_blocks"))
    # Fresh column identities, in case both sides come from one table.
    right = right.select([F.col(name).alias(name) for name in right.columns])
    schema = _result_schema(queries, items, on)
    arrow_schema = to_arrow_schema(schema)
    cell = [*scope, "_qb", "_ib"]

    def search(query_rows: pa.Table, item_rows: pa.Table) -> pa.Table:
        if not len(query_rows) or not len(item_rows):
            return arrow_schema.empty_table()
        values = {name: query_rows[name][0].as_py() for name in on}
        return pa.concat_tables(
            _pairs(query_rows, _item_block(item_rows), k, values, arrow_schema))

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, schema)


def assign_to_centroids(
    rows: DataFrame,
    centroids: DataFrame,
    threshold: float,
    on: Sequence[str] = ("account_id", "run_id"),
    id_col: str = "ticket_id",
    vector_col: str = "embedding",
    cluster_col: str = "cluster_id",
    centroid_col: str = "centroid",
) -> DataFrame:
    """Most similar centroid of each row, if at or above ``threshold``.

    A scope without any centroid reports similarity -1.
    """
    on = list(on)
    best = nearest(rows, centroids, 1, on, id_col, vector_col, cluster_col, centroid_col)
    similarity = F.coalesce(F.lit(1.0) - F.col("distance"), F.lit(-1.0))
    found = best.withColumnRenamed("query_id", id_col)
    return rows.select(*on, id_col).join(found, [*on, id_col], "left").select(
        *on, id_col,
        F.when(similarity >= threshold, F.col("item_id")).alias(cluster_col),
        similarity.alias("similarity"),
    )


def recall(approximate: DataFrame, exact: DataFrame, on: Sequence[str] = ("account_id",)) -> DataFrame:
    """Share of the exact pairs that the approximate search found, in one row."""
    pair = [*on, "query_id", "item_id"]
    hits = approximate.select(*pair).withColumn("hit", F.lit(1))
    return exact.select(*pair).join(hits, pair, "left").agg(
        F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("found"),
        (F.count("hit") / F.count(F.lit(1))).alias("recall"))
