"""A stored approximate index: items by cell, extended without training.

Centres are fitted once, on the items with the smallest hashes (at most about
``sample_rows`` of them): the ``lists`` smallest are the first centres, and each
round moves a centre to the mean direction of the sample items nearest to it.
Everything is a function of the rows alone: no random start, sums of multiples of
2^-32 that do not depend on their order, ties at nine decimals to the smaller cell.

Items, all of them, are stored by batch and cell. A later batch is placed by the
same centres; it names the stored rows it replaces, so readers leave those out with
an anti-join on ids and no vector is shuffled. Only batches whose write has ended
count, and a batch that is written again replaces itself.

A query visits the cells nearest to it until they hold a stated share of the items
of its scope, and ``k`` at least. How many cells that is follows from how many rows
each holds, which only ids are read for. No query is left short.

Null vectors take no part; a zero vector has similarity 0 to every centre. Within
a batch an id should occur once in its scope.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from topicloom.functions.arrow import list_array
from topicloom.operators.nearest import (
    DEFAULT_K,
    TIE_DECIMALS,
    best_per_query,
    by_scope,
    nearest,
    unit_rows,
)
from topicloom.session import child_names, path_exists

SAMPLE_ROWS = 65_536
CENTRE_BYTES = 64 << 20
DEFAULT_SHARE = 50
_GRAIN = float(1 << 32)
_WHOLE = "_all"


@dataclass(frozen=True)
class CellIndex:
    """Items below ``path``, by batch and cell. ``on`` names the columns of a scope."""

    spark: SparkSession
    path: str
    on: tuple[str, ...] = ("account_id",)

    def batches(self) -> list[int]:
        """Numbers of the batches that are completely written."""
        names = [n for n in child_names(self.spark, f"{self.path}/items") if n.startswith("batch=")]
        return sorted(int(n.removeprefix("batch=")) for n in names
                      if path_exists(self.spark, f"{self.path}/items/{n}/_SUCCESS"))

    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and unit centres; as many as the index was built with at most."""
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").toArrow()
        if not len(rows):
            return np.zeros(0, dtype=np.int32), np.zeros((0, 0))
        return rows["cell"].to_numpy(), unit_rows(rows["centre"])

    def items(self, cells: Sequence[int] | None = None) -> DataFrame:
        """Current items; of some cells only, if named (partition filters)."""
        stored = self._stored(self.batches())
        return stored if cells is None else stored.filter(F.col("cell").isin([int(c) for c in cells]))

    def rows_by_cell(self) -> DataFrame:
        """How many items of each scope a cell holds; vectors are not read."""
        return self.items().groupBy(*self.on, "cell").agg(F.count(F.lit(1)).alias("rows"))

    def append(self, items: DataFrame, batch: int, item_id: str = "item_id", item_vector: str = "item_vector") -> None:
        """Place items in the cells there are. Batches go in ascending order."""
        rows = _usable(items, self.on, item_id, item_vector)
        key = [*self.on, "item_id"]
        older = [n for n in self.batches() if n < batch]
        if older:
            known = self._stored(older).select(*key, "batch").join(rows.select(*key), key, "left_semi")
            _write(known.withColumnRenamed("batch", "old_batch"), f"{self.path}/replaced/batch={batch}")
        placed = _placed(rows, *self.centres())
        _write(placed.hint("rebalance", "cell"), f"{self.path}/items/batch={batch}", "cell")

    def _stored(self, batches: list[int]) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/layout").schema
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/items").filter(F.col("batch").isin(batches))
        told = [n for n in batches if path_exists(self.spark, f"{self.path}/replaced/batch={n}")]
        if not told:
            return stored
        key = [*self.on, "item_id"]
        replaced = self.spark.read.parquet(*[f"{self.path}/replaced/batch={n}" for n in told])
        return stored.join(replaced.select(*key, F.col("old_batch").alias("batch")), [*key, "batch"], "left_anti")

    def search(self, queries: DataFrame, k: int = DEFAULT_K, share: int = DEFAULT_SHARE,
               query_id: str = "query_id", query_vector: str = "query_vector", **search: int) -> DataFrame:
        """The ``k`` nearest items in the visited cells, which hold ``share`` per cent of a scope or more.

        Returns the scope, query_id, item_id, distance, rank.
        """
        queries = queries.filter(F.col(query_vector).isNotNull()).select(
            *self.on, F.col(query_id).alias("query_id"), F.col(query_vector).alias("query_vector"))
        held = self.rows_by_cell()
        if not self.on:
            held, queries = held.withColumn(_WHOLE, F.lit(1)), queries.withColumn(_WHOLE, F.lit(1))
        scope = list(self.on) or [_WHOLE]
        cells = F.array_sort(F.collect_list(F.struct("cell", "rows")))
        held = held.groupBy(*scope).agg(cells.alias("_held")).select(
            *scope, F.col("_held.cell").alias("_cells"), F.col("_held.rows").alias("_rows"))
        asked = queries.join(held, scope)
        numbers, centres = self.centres()
        visits = _visits(numbers, centres, scope, k, share)

        # Cells that no query visits are not read.
        def seen(batches):
            every = set()
            for batch in batches:
                for _, _, rows, column in visits(batch):
                    every.update(numbers[column].tolist() if len(rows) else ())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(every), pa.int32())], ["cell"])

        wanted = [row.cell for row in asked.mapInArrow(seen, "cell int").distinct().collect()]
        schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())])
        names = queries.columns

        def visited(batches):
            for batch in batches:
                for part, _, rows, column in visits(batch):
                    copies = part.select(names).take(pa.array(rows))
                    found = copies.append_column("cell", pa.array(numbers[column].astype(np.int32)))
                    yield from found.cast(to_arrow_schema(schema)).to_batches()

        found = nearest(asked.mapInArrow(visited, schema), self.items(wanted), k, [*self.on, "cell"],
                        "query_id", "query_vector", **search)
        return best_per_query(found.drop("rank", "cell"), k, self.on)


def build_index(items: DataFrame, path: str, lists: int = 100, on: Sequence[str] = ("account_id",),
                item_id: str = "item_id", item_vector: str = "item_vector", rounds: int = 1,
                sample_rows: int = SAMPLE_ROWS) -> CellIndex:
    """Fit ``lists`` centres and store all items by cell, as batch 0."""
    spark = items.sparkSession
    rows = _usable(items, on, item_id, item_vector)
    total = rows.count()
    digest = F.md5(F.concat_ws("|", *[F.col(name).cast("string") for name in (*on, "item_id")]))
    sample = rows.withColumn("_key", digest)
    if total > sample_rows:
        limit = int(sample_rows / total * _GRAIN)
        sample = sample.filter(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") < limit)
    first = sample.orderBy("_key", "item_vector").limit(lists).select("item_vector").toArrow()
    numbers, centres = np.arange(len(first), dtype=np.int32), unit_rows(first["item_vector"]) if len(first) else None
    if centres is not None and centres.nbytes > CENTRE_BYTES:
        raise ValueError(f"{lists} centres of {centres.shape[1]} components exceed {CENTRE_BYTES} bytes")
    for _ in range(rounds if len(first) else 0):
        numbers, centres = _moved(sample, numbers, centres)
    stored = [(int(n), [float(x) for x in c]) for n, c in zip(numbers, centres, strict=True)] if len(first) else []
    _write(spark.createDataFrame(stored, "cell int, centre array<double>"), f"{path}/centres")
    layout = rows.withColumn("batch", F.lit(0)).withColumn("cell", F.lit(0)).limit(0)
    _write(layout, f"{path}/layout")
    index = CellIndex(spark, path, tuple(on))
    index.append(rows, 0)
    return index


def _usable(items: DataFrame, on: Sequence[str], item_id: str, item_vector: str) -> DataFrame:
    return items.filter(F.col(item_vector).isNotNull()).select(
        *on, F.col(item_id).alias("item_id"), F.col(item_vector).alias("item_vector"))


def _write(df: DataFrame, path: str, *by: str) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def _closeness(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if rows.shape[1] != centres.shape[1]:
        raise ValueError(f"vectors differ in length: {rows.shape[1]} and {centres.shape[1]}")
    return np.round(rows @ centres.T, TIE_DECIMALS)


def _placed(rows: DataFrame, numbers: np.ndarray, centres: np.ndarray) -> DataFrame:
    """Rows with the number of the nearest centre."""
    if not len(numbers):
        return rows.withColumn("cell", F.lit(0))

    def place(batches):
        for batch in batches:
            if len(batch):
                best = _closeness(unit_rows(batch["item_vector"]), centres).argmax(axis=1)
                yield batch.append_column("cell", pa.array(numbers[best].astype(np.int32)))

    return rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def _moved(sample: DataFrame, numbers: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean directions of the sample rows nearest to each centre; centres without any go."""

    def totals(batches):
        sums, rows = np.zeros_like(centres), np.zeros(len(centres), dtype=np.int64)
        for batch in batches:
            if len(batch):
                unit = unit_rows(batch["item_vector"])
                best = _closeness(unit, centres).argmax(axis=1)
                np.add.at(sums, best, np.round(unit * _GRAIN) / _GRAIN)
                rows += np.bincount(best, minlength=len(centres))
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), list_array(sums[used])], ["at", "sums"])

    entries = sample.select("item_vector").mapInArrow(totals, "at int, sums array<double>").select(
        "at", F.posexplode("sums").alias("position", "value"))
    rows = entries.groupBy("at", "position").agg(F.sum("value").alias("value")).toArrow()
    moved = np.zeros_like(centres)
    moved[rows["at"].to_numpy(), rows["position"].to_numpy()] = rows["value"].to_numpy()
    used = np.unique(rows["at"].to_numpy())
    lengths = np.linalg.norm(moved[used], axis=1, keepdims=True)
    return numbers[used], np.divide(moved[used], lengths, out=np.zeros_like(moved[used]), where=lengths > 0)


def _visits(numbers: np.ndarray, centres: np.ndarray, scope: list[str], k: int, share: int):
    """For a batch of queries: by scope its rows, and pairs of query row and place of a visited cell."""

    def visits(batch: pa.RecordBatch) -> Iterator[tuple[pa.Table, tuple, np.ndarray, np.ndarray]]:
        for key, part in by_scope(pa.Table.from_batches([batch]), scope):
            if not len(part) or not len(numbers):
                continue
            held = np.zeros(len(numbers), dtype=np.int64)
            held[np.searchsorted(numbers, part["_cells"][0].as_py())] = part["_rows"][0].as_py()
            need = max(k, -(-int(held.sum()) * share // 100))
            order = np.argsort(-_closeness(unit_rows(part["query_vector"]), centres), axis=1, kind="stable")
            there = held[order]
            before = np.cumsum(there, axis=1) - there
            rows, places = np.nonzero((before < need) & (there > 0))
            yield part, key, rows, order[rows, places]

    return visits
