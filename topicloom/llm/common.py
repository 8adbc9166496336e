"""Helpers shared by the operators: saved tables, batch sizes, Arrow bytes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.session import work_path

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
PARQUET_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
# Rows of one Arrow batch where whole texts go to Python: texts are long and uneven.
TEXT_BATCH_ROWS = 1000


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Bound what one Arrow batch of texts can hold in a worker."""
    spark.conf.set(ARROW_ROWS, str(rows))


@contextmanager
def batches_of(spark: SparkSession, size: int = BATCH_BYTES, rows: int | None = None) -> Iterator[None]:
    """Arrow batches of at most ``size`` bytes (one row at least) for the jobs run inside;
    ``rows`` that a scan decodes at a time, where rows are megabytes. The session's own
    settings hold again afterwards."""
    wanted = {ARROW_BYTES: str(size)} | ({PARQUET_ROWS: str(rows)} if rows else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row of a string column; null rows are empty."""
    return column.fill_null("").cast(pa.large_binary()).to_pylist()


def slices(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes, cut at blanks only: what splits a part
    into words never holds the words of a very long text at once."""
    at = 0
    while len(text) - at > size:
        cut = text.find(b" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def apart(docs: DataFrame, *own: str) -> DataFrame:
    """The columns ``own`` and all others in one struct, so that no name an operator adds
    can clash with theirs. ``together`` is the way back."""
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in own]
    return docs.select(*own, F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))


def together(df: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of ``docs`` from what was made of ``apart(docs, *own)``."""
    return df.select(*[F.col(c) if c in own else F.col(f"_rest.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = work_path(spark, f"llm-{purpose}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_below(part: Column, *keys: str) -> Column:
    """Whether the hash of ``keys`` lies in the first ``part`` of its range."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < part * float(1 << 30)


def by_hash(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows with a low hash of ``keys``, about half as many again as ``rows`` whatever the
    table's size (all of a table that has no more): what a bounded sample sorts. Counts
    ``df``, so that should be narrow."""
    count = df.count()
    return df if count <= 2 * rows else df.where(hash_below(F.lit(1.5 * rows / count), *keys))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null rows are empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
