"""Order-faithful leader clustering per (account, run).

Rows are taken in id order. Each joins the cluster whose centroid (the mean of
its members so far) is most similar, if that similarity reaches the threshold;
otherwise it opens a new cluster. The id of a cluster is the id of the row that
opened it, so a cluster keeps its name across reruns and batches.

Every choice depends on all earlier ones, yet no group has to pass through one
task. A group is cut into chunks of consecutive ids. A few chunks at a time are
folded side by side, each starting from the clusters *guessed* to exist at its
first row: the settled ones plus what the chunks before it did in the last
round. A chunk is settled once everything before it is settled and did not
change since the guess was made; the others run again from the better guess. At
least one chunk settles per round, and the outcome is the sequential one. The
method is optimistic concurrency control (Pan et al., NIPS 2013), taken to a
fixed point.

Groups of at most one chunk, usually nearly all of them, are folded in a single
lazy stage without rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from topicloom.functions.arrow import constant, list_array, matrix
from topicloom.session import work_path

DEFAULT_THRESHOLD = 0.70
DEFAULT_MIN_SIZE = 2
DEFAULT_CHUNK_ROWS = 16384
# A group is cut into about so many chunks, as long as those stay below the default.
CHUNKS_OF_A_GROUP = 32
LEAST_LOOKAHEAD = 8
COMPACT_AFTER = 4
# Components are taken as multiples of this. Sums of such numbers are exact doubles up
# to two million, whatever the order they are added in, so cutting changes nothing.
GRID = 2.0**-32
# Similarities equal at this many decimals are ties and go to the earliest cluster.
SIMILARITY_DECIMALS = 12
# Bytes of guessed sums that a block of steps may start from, for the look-ahead.
START_BYTES = 1 << 30

MEMBER, CLUSTER, DIGEST = "member", "cluster", "digest"


@dataclass(frozen=True)
class LeaderPass:
    """Outcome of a pass; both views come from one table of placements."""

    placed: DataFrame
    keys: tuple[str, ...]
    id_col: str

    @property
    def members(self) -> DataFrame:
        rows = self.placed.filter(F.col("kind") == MEMBER)
        return rows.select(*self.keys, F.col("id").alias(self.id_col), "cluster_id")

    @property
    def clusters(self) -> DataFrame:
        """Sum and count per cluster: the state a later batch continues from."""
        rows = self.placed.filter(F.col("kind") == CLUSTER)
        return rows.select(*self.keys, "cluster_id", "vector_sum", "member_count")

    def saved(self, path: str | None = None) -> LeaderPass:
        """Compute once: write the placements and go on from the stored table."""
        spark = self.placed.sparkSession
        path = path or work_path(spark, "placed")
        self.placed.write.partitionBy("kind").parquet(path)
        return replace(self, placed=spark.read.schema(self.placed.schema).parquet(path))


class _Clusters:
    """Growing (sum, count) table of one group, earliest cluster first."""

    def __init__(self, threshold: float, dimension: int):
        self.threshold = threshold
        self.size = 0
        self.ids = np.empty(16, dtype=np.int64)
        self.sums = np.empty((16, dimension))
        self.norms = np.empty(16)

    def open(self, cluster_id: int, total: np.ndarray) -> int:
        if self.size == len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            self.sums = np.concatenate([self.sums, np.empty_like(self.sums)])
            self.norms = np.concatenate([self.norms, np.empty_like(self.norms)])
        at = self.size
        self.ids[at], self.sums[at], self.norms[at] = cluster_id, total, np.linalg.norm(total)
        self.size += 1
        return at

    def best(self, vector: np.ndarray) -> int | None:
        """Most similar cluster at or above the threshold; the first one on ties.

        Cosine ignores scale, so comparing with the sum equals comparing with
        the mean.
        """
        if self.size == 0:
            return None
        scale = self.norms[: self.size] * np.linalg.norm(vector)
        dots = self.sums[: self.size] @ vector
        similarity = np.divide(dots, scale, out=np.zeros(self.size), where=scale > 0)
        similarity = np.round(similarity, SIMILARITY_DECIMALS)
        at = int(np.argmax(similarity))
        return at if similarity[at] >= self.threshold else None

    def join(self, at: int, vector: np.ndarray) -> None:
        self.sums[at] += vector
        self.norms[at] = np.linalg.norm(self.sums[at])


_OUT = pa.schema([
    ("kind", pa.string()), ("id", pa.int64()), ("cluster_id", pa.int64()),
    ("vector_sum", pa.list_(pa.float64())), ("member_count", pa.int64()),
])


def _part(rows: int, **columns: object) -> pa.Table:
    """Output rows of one kind; columns not given are null."""
    arrays = [
        pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(rows, f.type)
        for f in _OUT
    ]
    return pa.Table.from_arrays(arrays, schema=_OUT)


def _fold_chunk(rows: pa.Table, start: pa.Table | None, threshold: float) -> pa.Table:
    """Sequential pass over one chunk; returns placements and the sums it added."""
    rows = rows.sort_by("id")
    vectors = np.round(matrix(rows["vector"]) / GRID) * GRID
    ids = rows["id"].to_numpy()
    clusters = _Clusters(threshold, vectors.shape[1])
    if start is not None and len(start):
        start = start.sort_by([("cluster_id", "ascending"), ("source_step", "ascending")])
        names = start["cluster_id"].to_numpy()
        firsts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        totals = np.add.reduceat(matrix(start["vector_sum"]), firsts, axis=0)
        for name, total in zip(names[firsts], totals, strict=True):
            clusters.open(name, total)
    slots = np.empty(len(ids), dtype=np.int64)
    for i, vector in enumerate(vectors):
        at = clusters.best(vector)
        if at is None:
            at = clusters.open(ids[i], vector)
        else:
            clusters.join(at, vector)
        slots[i] = at
    placed_in = clusters.ids[slots]

    touched, local = np.unique(slots, return_inverse=True)
    added = np.zeros((len(touched), vectors.shape[1]))
    np.add.at(added, local, vectors)
    digest = hashlib.blake2b(placed_in.tobytes(), digest_size=8).digest()
    return pa.concat_tables([
        _part(len(ids), kind=[MEMBER] * len(ids), id=ids, cluster_id=placed_in),
        _part(len(touched), kind=[CLUSTER] * len(touched), cluster_id=clusters.ids[touched],
              vector_sum=list_array(added), member_count=np.bincount(local)),
        _part(1, kind=[DIGEST], id=[int.from_bytes(digest, "big", signed=True)]),
    ])


def _placed_schema(rows: DataFrame, keys: Sequence[str]) -> T.StructType:
    fields = [rows.schema[key] for key in keys]
    fields += [
        T.StructField("step", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("cluster_id", T.LongType()),
        T.StructField("vector_sum", T.ArrayType(T.DoubleType())),
        T.StructField("member_count", T.LongType()),
    ]
    return T.StructType(fields)


def _fold_chunks(rows: DataFrame, start: DataFrame | None, keys: Sequence[str],
                 threshold: float) -> DataFrame:
    """Fold every (group, step) of ``rows`` on its own, from ``start`` if given."""
    group = [*keys, "step"]
    schema = _placed_schema(rows, keys)
    arrow_schema = to_arrow_schema(schema)

    def finish(chunk: pa.Table, base: pa.Table | None) -> pa.Table:
        if not len(chunk):
            return arrow_schema.empty_table()
        out = _fold_chunk(chunk, base, threshold)
        for at, name in enumerate(group):
            kind = arrow_schema.field(name).type
            out = out.add_column(at, name, constant(chunk[name][0].as_py(), len(out), kind))
        return out

    if start is None:
        return rows.groupBy(*group).applyInArrow(lambda chunk: finish(chunk, None), schema)
    return rows.groupBy(*group).cogroup(start.groupBy(*group)).applyInArrow(finish, schema)


def _sum_by_cluster(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    summed = parts.groupBy(*keys, "cluster_id").agg(
        Summarizer.sum(array_to_vector("vector_sum")).alias("_sum"),
        F.sum("member_count").alias("member_count"),
    )
    return summed.select(*keys, "cluster_id", vector_to_array("_sum").alias("vector_sum"), "member_count")


def leader_pass(
    df: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    keys: Sequence[str] = ("account_id", "run_id"),
    id_col: str = "ticket_id",
    vector_col: str = "embedding",
    state: DataFrame | None = None,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    lookahead: int | None = None,
) -> LeaderPass:
    """Cluster every group of ``df`` exactly; ``state`` continues earlier passes.

    Groups above ``chunk_rows`` are cut into chunks of at least that many rows. As
    each chunk costs a round or part of one, chunks of larger groups are longer, up
    to ``DEFAULT_CHUNK_ROWS``, which bounds what one task holds (``chunk_rows``
    does, if that is more). ``lookahead`` is how many chunks of a group are guessed
    side by side at most, by default one per core.

    Groups that are cut run in rounds and are computed before this
    returns, so hand in a stored table rather than a costly unsaved plan.
    """
    if lookahead is None:
        lookahead = max(LEAST_LOOKAHEAD, df.sparkSession.sparkContext.defaultParallelism)
    if chunk_rows < 1 or lookahead < 1:
        raise ValueError("chunk_rows and lookahead must be at least 1")
    keys = tuple(keys)
    rows = df.filter(F.col(vector_col).isNotNull()).select(
        *keys, F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")
    )
    large = rows.groupBy(*keys).count().filter(F.col("count") > chunk_rows)
    most = large.agg(F.max("count")).first()[0]
    if most is None:
        return LeaderPass(_one_stage(rows, state, keys, threshold), keys, id_col)
    large = large.select(*keys)
    chunk_rows = rows_of_a_chunk(most, chunk_rows)

    small = rows.join(large, list(keys), "left_anti")
    hot = rows.join(large, list(keys), "left_semi")
    small_state = hot_state = None
    if state is not None:
        small_state = state.join(large, list(keys), "left_anti")
        hot_state = state.join(large, list(keys), "left_semi")
    settled = _Rounds(hot, hot_state, keys, threshold, chunk_rows, lookahead).run()
    placed = _one_stage(small, small_state, keys, threshold)
    columns = [*keys, *_OUT.names]
    return LeaderPass(placed.select(*columns).unionByName(settled.select(*columns)), keys, id_col)


def rows_of_a_chunk(most: int, least: int) -> int:
    """Rows of a chunk, where the largest group has ``most``."""
    return max(least, min(DEFAULT_CHUNK_ROWS, -(-most // CHUNKS_OF_A_GROUP)))


def _one_stage(rows: DataFrame, state: DataFrame | None, keys: Sequence[str],
               threshold: float) -> DataFrame:
    rows = rows.withColumn("step", F.lit(0).cast("long"))
    if state is None:
        return _fold_chunks(rows, None, keys, threshold)
    start = state.select(
        *keys, "cluster_id", "vector_sum", "member_count",
        F.lit(0).cast("long").alias("step"), F.lit(-1).cast("long").alias("source_step"),
    )
    placed = _fold_chunks(rows, start, keys, threshold)
    deltas = placed.filter(F.col("kind") == CLUSTER)
    totals = _sum_by_cluster(
        state.select(*keys, "cluster_id", "vector_sum", "member_count").unionByName(
            deltas.select(*keys, "cluster_id", "vector_sum", "member_count")
        ),
        keys,
    )
    return placed.filter(F.col("kind") == MEMBER).unionByName(
        totals.withColumn("kind", F.lit(CLUSTER)), allowMissingColumns=True
    )


class _Rounds:
    """Driver loop of the rounds; it sees counts only, tables hold the rows.

    A block is a few consecutive steps settled together. ``placed`` keeps every
    round's outcome below its block; the last round of a block is the valid one.
    """

    def __init__(self, hot: DataFrame, state: DataFrame | None, keys: tuple[str, ...],
                 threshold: float, chunk_rows: int, lookahead: int):
        self.spark: SparkSession = hot.sparkSession
        self.keys, self.threshold, self.lookahead = keys, threshold, lookahead
        self.work = work_path(self.spark, "leader")
        self._write_chunks(hot, chunk_rows)
        self.chunks = self._read("chunks", hot.schema.add("step", "long"))
        self.schema = _placed_schema(self.chunks, keys)
        self.valid: list[str] = []
        # Sums of settled blocks: one compacted table, then the blocks since.
        self.sums: list[DataFrame] = []
        if state is not None:
            self.sums.append(self._save(state.select(*self._sum_columns), "state-start"))

    @property
    def _sum_columns(self) -> list[str]:
        return [*self.keys, "cluster_id", "vector_sum", "member_count"]

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.work}/{name}")
        return self._read(name, df.schema)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.work}/{name}")

    def _write_chunks(self, hot: DataFrame, chunk_rows: int) -> None:
        """Number runs of at most ``chunk_rows`` consecutive ids per group.

        Range partitioning spreads a hot group over many tasks in id order;
        each task cuts its sorted share while streaming through it.
        """
        keys = list(self.keys)
        ordered = hot.repartitionByRange(*keys, "id").sortWithinPartitions(*keys, "id")
        schema = hot.schema.add("chunk", "long")

        def cut(batches):
            chunk = TaskContext.get().partitionId() << 32
            last, seen = None, 0
            for batch in batches:
                if not len(batch):
                    continue
                groups = pa.Table.from_batches([batch]).select(keys)
                first = groups.slice(0, 1).to_pylist()[0]
                starts = np.flatnonzero(np.r_[first != last, _changes(groups)])
                # Place of each row in its group; the first may go on from before.
                place = np.arange(len(batch)) + (seen if not len(starts) or starts[0] else 0)
                runs = np.searchsorted(starts, np.arange(len(batch)), side="right")
                fresh = runs > 0
                place[fresh] = np.arange(len(batch))[fresh] - starts[runs[fresh] - 1]
                marks = chunk + np.cumsum(place % chunk_rows == 0)
                chunk, seen = int(marks[-1]), int(place[-1]) + 1
                last = groups.slice(len(groups) - 1, 1).to_pylist()[0]
                yield batch.append_column("chunk", pa.array(marks, pa.int64()))

        ordered.mapInArrow(cut, schema).write.parquet(f"{self.work}/cut")
        cut_rows = self._read("cut", schema)
        chunk_list = cut_rows.select(*keys, "chunk").distinct()
        earlier = F.row_number().over(Window.partitionBy(*keys).orderBy("chunk")) - 1
        steps = chunk_list.withColumn("step", earlier.cast("long"))
        # One directory per step, so that a round reads its own chunks only.
        (cut_rows.join(steps, [*keys, "chunk"]).drop("chunk")
         .write.partitionBy("step").parquet(f"{self.work}/chunks"))

    def run(self) -> DataFrame:
        steps = self.chunks.agg(F.max("step")).first()[0] + 1
        first, width = 0, 1
        while first < steps:
            last = min(first + width, steps)
            rounds = self._settle(first, last)
            # Look further ahead while guesses hold, less far when they do not.
            held = rounds <= 1 + width // 2
            width = min(self._affordable(), width * 2) if held else max(1, width // 2)
            first = last
        every = self.spark.read.schema(
            T.StructType([*self.schema]).add("block", "long").add("round", "long")
        ).parquet(f"{self.work}/placed")
        members = every.filter(
            F.concat_ws("-", "block", "round").isin(self.valid) & (F.col("kind") == MEMBER))
        final = _sum_by_cluster(self._settled_sums(), self.keys).withColumn("kind", F.lit(CLUSTER))
        return members.drop("block", "round").unionByName(final, allowMissingColumns=True)

    def _affordable(self) -> int:
        """Steps side by side: no more than asked for, and than their starts may weigh."""
        row = self._settled_sums().agg(F.sum(F.size("vector_sum") * 8)).first()
        return max(1, min(self.lookahead, START_BYTES // max(row[0] or 1, 1)))

    def _settled_sums(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.sums) if self.sums else None

    def _settle(self, first: int, last: int) -> int:
        """Run rounds until steps ``first`` to ``last - 1`` are settled."""
        block = self.chunks.filter((F.col("step") >= first) & (F.col("step") < last))
        settled = self._settled_sums()
        latest, upto, rounds, pending = None, None, 0, True
        while pending:
            todo = block if upto is None else self._after(block, upto)
            start = self._starts(settled, latest, upto, first, last)
            out = _fold_chunks(todo, start, self.keys, self.threshold)
            if latest is not None:
                done = latest.join(upto, list(self.keys)).filter(F.col("step") <= F.col("upto"))
                out = out.unionByName(done.drop("upto"))
            name = f"placed/block={first}/round={rounds}"
            out.write.partitionBy("kind").parquet(f"{self.work}/{name}")
            current = self._read(name, self.schema)
            # A single step starts from settled sums only, so it is settled.
            pending = last - first > 1
            if pending:
                upto, pending = self._frontier(current, latest, f"upto-{first}-{rounds}")
            latest, rounds = current, rounds + 1
        self.valid.append(f"{first}-{rounds - 1}")
        self.sums.append(latest.filter(F.col("kind") == CLUSTER).select(*self._sum_columns))
        if len(self.sums) > COMPACT_AFTER:
            compact = _sum_by_cluster(self._settled_sums(), self.keys)
            self.sums = [self._save(compact, f"state-{last}")]
        return rounds

    def _after(self, df: DataFrame, upto: DataFrame) -> DataFrame:
        return df.join(upto, list(self.keys)).filter(F.col("step") > F.col("upto")).drop("upto")

    def _starts(self, settled: DataFrame | None, latest: DataFrame | None, upto: DataFrame | None,
                first: int, last: int) -> DataFrame | None:
        """Sums each pending step begins with: settled ones and guessed ones."""
        columns = [*self._sum_columns, "source_step"]
        parts = []
        if settled is not None:
            parts.append(settled.withColumn("source_step", F.lit(first - 1).cast("long")))
        if latest is not None:
            guessed = latest.filter(F.col("kind") == CLUSTER)
            parts.append(guessed.withColumn("source_step", F.col("step")))
        if not parts:
            return None
        known = reduce(DataFrame.unionByName, [part.select(*columns) for part in parts])
        known = known.filter(F.col("source_step") < last - 1)
        spread = running_sums(known, self.keys, last)
        return spread if upto is None else self._after(spread, upto)

    def _frontier(self, current: DataFrame, previous: DataFrame | None,
                  name: str) -> tuple[DataFrame, bool]:
        """Per group the last settled step, and whether any step is left.

        A group is settled up to the first step whose outcome still changed.
        """
        now = _digests(current)
        if previous is None:
            changed = F.lit(True)
        else:
            before = _digests(previous).withColumnRenamed("id", "old")
            now = now.join(before, [*self.keys, "step"], "left")
            changed = ~F.col("id").eqNullSafe(F.col("old"))
        upto = F.coalesce(F.min(F.when(changed, F.col("step"))), F.max("step"))
        reached = now.groupBy(*self.keys).agg(upto.alias("upto"), F.max("step").alias("top"))
        left = Observation()
        watched = reached.observe(left, F.count_if(F.col("upto") < F.col("top")).alias("groups"))
        saved = self._save(watched.drop("top"), name)
        return saved, left.get["groups"] > 0


def running_sums(parts: DataFrame, keys: Sequence[str], last: int) -> DataFrame:
    """What each cluster holds at the start of every step before ``last``: one row for a
    cluster and step, so at most steps x clusters rows."""
    schema = T.StructType([*parts.schema]).add("step", "long")
    names = schema.names

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("source_step")
        source = table["source_step"].to_numpy()
        steps = np.arange(source[0] + 1, last)
        upto = np.searchsorted(source, steps) - 1
        first = table.slice(0, 1).take(pa.array(np.zeros(len(steps), np.int64)))
        columns = {name: first[name] for name in [*keys, "cluster_id"]} | {
            "vector_sum": list_array(np.cumsum(matrix(table["vector_sum"]), axis=0)[upto]),
            "member_count": pa.array(np.cumsum(table["member_count"].to_numpy())[upto]),
            "source_step": pa.array(steps - 1), "step": pa.array(steps)}
        return pa.table({name: columns[name] for name in names})

    return parts.groupBy(*keys, "cluster_id").applyInArrow(run, schema)


def _changes(groups: pa.Table) -> np.ndarray:
    """For every row but the first: does its group differ from the row before?"""
    changed = np.zeros(max(len(groups) - 1, 0), dtype=bool)
    for column in groups.columns:
        codes = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        changed |= codes[1:] != codes[:-1]
    return changed


def _digests(placed: DataFrame) -> DataFrame:
    return placed.filter(F.col("kind") == DIGEST).drop("kind", "cluster_id", "vector_sum", "member_count")


def cluster_sizes(members: DataFrame, keys: Sequence[str] = ("account_id", "run_id")) -> DataFrame:
    return members.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("ticket_count"))


def split_by_size(members: DataFrame, min_size: int = DEFAULT_MIN_SIZE,
                  keys: Sequence[str] = ("account_id", "run_id")) -> DataFrame:
    """Clusters below ``min_size`` dissolve: their rows stay, without a cluster.

    Counting and joining back instead of a window keeps one huge cluster from
    being sorted in one task.
    """
    sized = members.join(cluster_sizes(members, keys), [*keys, "cluster_id"])
    kept = F.col("ticket_count") >= min_size
    return (
        sized.withColumn("is_clustered", kept)
        .withColumn("cluster_id", F.when(kept, F.col("cluster_id")))
        .drop("ticket_count")
    )
