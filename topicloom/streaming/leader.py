"""Online leader clustering: arrivals join the clusters of earlier batches.

State is kept by bucket, a hash of the group. A batch appends what it changed: the members
it placed and the clusters of the groups it had arrivals for. It reads the buckets of its
arrivals only, so idle groups elsewhere cost nothing. Every ``fold_every`` batches the
buckets touched since are folded into one part each and older parts are dropped, so that
neither the files nor the folders a batch looks at grow with the batches before it.

A replayed batch rewrites its own changes, and its fold if it had one, from what was
stored before it. A ticket that was placed before, or comes twice in a batch, counts once.
Within a batch rows count in id order; with arrivals in id order the outcome equals the
batch job's. Who reads the state while the stream runs must be done within
``fold_every`` batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from topicloom.operators.leader import (
    CLUSTER,
    DEFAULT_CHUNK_ROWS,
    DEFAULT_THRESHOLD,
    MEMBER,
    leader_pass,
)
from topicloom.session import child_names, drop_path, path_exists

BUCKETS = 64
FOLD_EVERY = 16
_LAYOUT = "buckets-"


def _clusters_schema(key_fields: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([*key_fields]).add("cluster_id", "long").add(
        "vector_sum", T.ArrayType(T.DoubleType())).add("member_count", "long")


def _members_schema(key_fields: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([*key_fields]).add("id", "long").add("cluster_id", "long")


def _numbers(names: Iterable[str], prefix: str) -> list[int]:
    return [int(name.removeprefix(prefix)) for name in names if name.startswith(prefix)]


class BucketState:
    """Members and clusters below a folder: ``parts/kind=/bucket=/upto=`` holds all of a
    bucket before batch ``upto``, ``changes/batch=/kind=/bucket=`` what a batch added."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], key_fields: Sequence[T.StructField],
                 buckets: int | None = None):
        layouts = _numbers(child_names(spark, path), _LAYOUT)
        if layouts and buckets not in (None, layouts[0]):
            raise ValueError(f"the state in {path} has {layouts[0]} buckets, not {buckets}")
        self.spark, self.keys = spark, list(keys)
        self.buckets = buckets or (layouts[0] if layouts else BUCKETS)
        self.root = f"{path}/{_LAYOUT}{self.buckets}"
        self.schemas = {MEMBER: _members_schema(key_fields), CLUSTER: _clusters_schema(key_fields)}

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def batches(self, before: int) -> list[int]:
        return sorted(n for n in _numbers(child_names(self.spark, f"{self.root}/changes"), "batch=") if n < before)

    def folders(self, kind: str, buckets: Iterable[int] | None, before: int, folded: int) -> tuple[list[str], list[str]]:
        """Parts and changes that hold the ``buckets`` as of batch ``before``, of parts that
        reach to ``folded`` at most. Names are listed, no data is read."""
        parts, changes, upto = [], [], {}
        every = buckets is None
        for bucket in _numbers(child_names(self.spark, f"{self.root}/parts/kind={kind}"), "bucket=") if every else buckets:
            place = f"{self.root}/parts/kind={kind}/bucket={bucket}"
            upto[bucket] = max((n for n in _numbers(child_names(self.spark, place), "upto=") if n <= folded), default=0)
            if upto[bucket]:
                parts.append(f"{place}/upto={upto[bucket]}")
        for batch in self.batches(before):
            place = f"{self.root}/changes/batch={batch}/kind={kind}"
            for bucket in _numbers(child_names(self.spark, place), "bucket="):
                if (every or bucket in upto) and batch >= upto.get(bucket, 0):
                    changes.append(f"{place}/bucket={bucket}")
        return parts, changes

    def read(self, kind: str, buckets: Iterable[int] | None, before: int, folded: int) -> DataFrame:
        """Rows of a kind, with ``bucket`` and the ``batch`` of the change (-1 if folded)."""
        schema = self.schemas[kind]
        parts, changes = self.folders(kind, buckets, before, folded)
        placed = T.StructType([*schema]).add("bucket", "integer")
        dated = T.StructType([*placed]).add("batch", "long")
        out = self.spark.createDataFrame([], dated)
        if parts:
            stored = self.spark.read.schema(placed).option("basePath", f"{self.root}/parts").parquet(*parts)
            out = out.unionByName(stored.withColumn("batch", F.lit(-1).cast("long")).select(*dated.names))
        if changes:
            stored = self.spark.read.schema(dated).option("basePath", f"{self.root}/changes").parquet(*changes)
            out = out.unionByName(stored.select(*dated.names))
        return out

    def clusters(self, buckets: Iterable[int] | None, before: int, folded: int) -> DataFrame:
        """The clusters of each group as its last change left them."""
        every = self.read(CLUSTER, buckets, before, folded)
        last = every.groupBy(*self.keys).agg(F.max("batch").alias("batch"))
        return every.join(last, [*self.keys, "batch"], "left_semi").drop("batch")

    def append(self, placed: DataFrame, batch: int) -> None:
        (placed.where(F.col("kind").isin(MEMBER, CLUSTER)).withColumn("bucket", self.bucket())
         .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("kind", "bucket")
         .parquet(f"{self.root}/changes/batch={batch}"))

    def fold(self, before: int, fold_every: int) -> None:
        """One part for each bucket that has changes; parts and changes older than the fold
        before this one are dropped."""
        touched = self.batches(before)
        buckets = sorted({b for n in touched for b in _numbers(
            child_names(self.spark, f"{self.root}/changes/batch={n}/kind={CLUSTER}"), "bucket=")})
        members = self.read(MEMBER, buckets, before, before - 1).drop("batch")
        clusters = self.clusters(buckets, before, before - 1)
        for kind, rows in ((MEMBER, members), (CLUSTER, clusters)):
            (rows.withColumns({"kind": F.lit(kind), "upto": F.lit(before)})
             .repartition("bucket", F.pmod(F.xxhash64(*self.keys, "cluster_id"), F.lit(8)))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "bucket", "upto")
             .parquet(f"{self.root}/parts"))
            for bucket in buckets:
                place = f"{self.root}/parts/kind={kind}/bucket={bucket}"
                for old in sorted(n for n in _numbers(child_names(self.spark, place), "upto=") if n < before)[:-1]:
                    drop_path(self.spark, f"{place}/upto={old}")
        for old in touched:
            if old < before - fold_every:
                drop_path(self.spark, f"{self.root}/changes/batch={old}")

    def now(self) -> int:
        """The first batch that is not complete."""
        done = [n for n in self.batches(1 << 62) if path_exists(self.spark, f"{self.root}/changes/batch={n}/_SUCCESS")]
        return max(done, default=-1) + 1


def streamed_clusters(spark: SparkSession, path: str, rows: DataFrame,
                      keys: Sequence[str] = ("account_id", "run_id")) -> DataFrame:
    """Sum and count of every cluster now; ``rows`` has the key columns' types."""
    state = BucketState(spark, path, keys, [rows.schema[key] for key in keys])
    now = state.now()
    return state.clusters(None, now, now).drop("bucket")


def streamed_members(spark: SparkSession, path: str, rows: DataFrame,
                     keys: Sequence[str] = ("account_id", "run_id"), id_col: str = "ticket_id") -> DataFrame:
    """Every ticket placed so far with its cluster."""
    state = BucketState(spark, path, keys, [rows.schema[key] for key in keys])
    now = state.now()
    return state.read(MEMBER, None, now, now).select(*keys, F.col("id").alias(id_col), "cluster_id")


def stream_leaders(tickets: DataFrame, path: str, checkpoint: str,
                   threshold: float = DEFAULT_THRESHOLD,
                   keys: Sequence[str] = ("account_id", "run_id"),
                   id_col: str = "ticket_id", vector_col: str = "embedding",
                   chunk_rows: int = DEFAULT_CHUNK_ROWS, buckets: int | None = None,
                   fold_every: int = FOLD_EVERY) -> StreamingQuery:
    """Cluster a stream; ends once all available input is in.

    ``buckets`` is fixed by the first run (``BUCKETS``): choose it so that one bucket's
    state can be rewritten at a fold.
    """
    keys = list(keys)
    key_fields = [tickets.schema[key] for key in keys]

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = BucketState(spark, path, keys, key_fields, buckets)
        if batch_id and batch_id % fold_every == 0:
            state.fold(batch_id, fold_every)
        arrived = batch.select(*keys, id_col, vector_col).dropDuplicates([*keys, id_col])
        clusters = None
        if batch_id:
            # At most as many rows as there are buckets.
            here = [row[0] for row in batch.select(state.bucket()).distinct().collect()]
            before = state.read(MEMBER, here, batch_id, batch_id).select(*keys, F.col("id").alias(id_col))
            arrived = arrived.join(before, [*keys, id_col], "left_anti")
        # The arrivals are read more than once below; a table keeps that cheap.
        arrived.write.mode("overwrite").parquet(f"{path}/arrived")
        arrived = spark.read.schema(arrived.schema).parquet(f"{path}/arrived")
        if batch_id:
            clusters = state.clusters(here, batch_id, batch_id).drop("bucket").join(
                arrived.select(*keys).distinct(), keys, "left_semi")
        result = leader_pass(arrived, threshold, keys, id_col, vector_col, clusters, chunk_rows)
        state.append(result.placed, batch_id)

    return (tickets.writeStream.foreachBatch(apply)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
