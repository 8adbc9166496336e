"""Hard negatives by exact integer scores, from Kronecker-packed products.

*Scores.* Components become floor(scale * x), taken as doubles; a row's score is its
integer inner product with an anchor. A block of candidates keeps one wide integer for
each component: the component of every candidate, biased to be nonnegative, in a field of
its own. One multiplication by an anchor's component multiplies all fields, the sum over
the components holds all scores. The width of a field follows from the largest components
of the block, so no field runs over and scores are exact whatever the vectors are.

*Pairs of blocks.* Anchors meet all rows in blocks that are bounded by bytes. A task gets
one block of either and returns the best rows only, ``positives`` or ``negatives`` of
them for an anchor; the blocks' bests are ranked by a window that Spark cuts before the
shuffle. Positives come first (rows of the anchor's label, packed by label), as the
scores that negatives may have depend on them. A row is copied once for each block of
anchors, an anchor once for each block of rows.

Rows with a null id, label, vector or any null or non-finite component take no part.
Rows equal in id, label and vector count once; others that share an id are rows of their
own, but none is paired with an anchor of its id. Higher scores come first, ties go to
the smaller id. Shorter vectors count as filled up with zeros; empty ones score 0. Scores
beyond 64 bits count as the largest or smallest long. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import saved

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
# Negatives score at least and at most so many per cent of the positive.
LOW, HIGH = 30, 90
# Of the components of a block of rows and of one of anchors, as doubles.
ROW_BYTES, ANCHOR_BYTES = 8 << 20, 16 << 20
LONG = np.iinfo(np.int64)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python's where these are too short."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    exact = [int(b) if math.isfinite(b) else int(a) * scale for a, b in zip(x.ravel(), y.ravel())]
    return np.array(exact, object).reshape(x.shape)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


class Packed:
    """Rows of whole numbers as one wide integer for each component.

    ``reach``: the largest magnitude of a component that rows are multiplied by.
    """

    def __init__(self, rows: np.ndarray, reach: int):
        self.rows, self.bias = len(rows), _largest(rows)
        # No sum of products is larger, whatever its sign.
        self.most = rows.shape[1] * 2 * self.bias * reach
        need = max(1, ((2 * self.most).bit_length() + 7) // 8)
        self.width = next((w for w in (1, 2, 4, 8) if w >= need), need)
        self.parts = [self._pack(rows[:, k]) for k in range(rows.shape[1])]
        self.offset = int.from_bytes(self.most.to_bytes(self.width, "little") * self.rows, "little")

    def _pack(self, column: np.ndarray) -> int:
        if self.width <= 8:
            fields = (column + self.bias).astype(f"<u{self.width}").tobytes()
        else:
            fields = b"".join((int(c) + self.bias).to_bytes(self.width, "little") for c in column)
        return int.from_bytes(fields, "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products of all rows with ``anchor``."""
        total = self.offset
        for a, part in zip(anchor, self.parts):
            if a:
                total += a * part
        data = total.to_bytes(self.rows * self.width, "little")
        added = self.most + self.bias * sum(anchor)
        if self.width < 8:
            return np.frombuffer(data, f"<u{self.width}").astype(np.int64) - added
        if self.width == 8:  # differences are right modulo 2^64
            return (np.frombuffer(data, "<u8") - np.uint64(added % (1 << 64))).view(np.int64)
        exact = (int.from_bytes(data[k : k + self.width], "little") - added for k in range(0, len(data), self.width))
        return np.array([min(max(s, LONG.min), LONG.max) for s in exact], np.int64)


def first_rows(scores: np.ndarray, among: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` best of the places ``among`` (in order of their ids), best first."""
    own = scores[among]
    if len(own) > count:
        last = np.partition(own, len(own) - count)[len(own) - count]
        above, equal = among[own > last], among[own == last]
        among = np.sort(np.concatenate([above, equal[: count - len(above)]]))
        own = scores[among]
    return among[np.lexsort((among, ~own))]


def _vectors(column: pa.ChunkedArray, length: int) -> np.ndarray:
    """Rows of an array column, filled up with zeros."""
    column = column.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    x = np.zeros((len(column), length))
    x[np.arange(length)[None] < sizes[:, None]] = flat
    return x


class _Blocks:
    """A block of rows in order of their ids, and one of anchors."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, scale: int):
        rows = rows.sort_by([("id", "ascending"), ("label", "ascending"), ("row", "ascending")])
        length = max(pc.max(pc.list_value_length(c)).as_py() for c in (rows.column("v"), anchors.column("anchor_v")))
        self.ids, self.labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        self.values = whole(_vectors(rows.column("v"), length), scale)
        asked = whole(_vectors(anchors.column("anchor_v"), length), scale)
        self.reach, self.asked = _largest(asked), asked.tolist()
        self.anchor, self.own, self.label = (
            anchors.column(c).to_pylist() for c in ("anchor", "anchor_id", "anchor_label"))

    def packed(self, places: np.ndarray) -> Packed:
        return Packed(self.values[places], self.reach)


def _table(parts: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0)] * len(schema)
    return pa.table([pa.array(c, kind.type) for c, kind in zip(columns, schema)], schema=schema)


_POSITIVE = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()),
                       ("positive_score", pa.int64())])
_NEGATIVE = pa.schema([*_POSITIVE, ("place", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _best_positives(rows: pa.Table, anchors: pa.Table, count: int, scale: int) -> pa.Table:
    if not len(rows) or not len(anchors):
        return _table([], _POSITIVE)
    block, found = _Blocks(rows, anchors, scale), []
    for label in sorted(set(block.label) & set(block.labels.tolist())):
        places = np.flatnonzero(block.labels == label)
        packed = block.packed(places)
        for k in (k for k, other in enumerate(block.label) if other == label):
            scores = packed.scores(block.asked[k])
            best = first_rows(scores, np.flatnonzero(block.ids[places] != block.own[k]), count)
            found.append((np.full(len(best), block.anchor[k]), np.full(len(best), block.own[k]),
                          block.ids[places[best]], scores[best]))
    return _table(found, _POSITIVE)


def _best_negatives(rows: pa.Table, anchors: pa.Table, count: int, low: int, high: int, scale: int) -> pa.Table:
    if not len(rows) or not len(anchors):
        return _table([], _NEGATIVE)
    block, found = _Blocks(rows, anchors, scale), []
    packed = block.packed(np.arange(len(block.ids)))
    for k, positives in enumerate(anchors.column("positives").to_pylist()):
        scores = packed.scores(block.asked[k])
        others = (block.labels != block.label[k]) & (block.ids != block.own[k])
        for positive in positives:
            score = positive["positive_score"]
            # low * positive <= 100 * s <= high * positive, in whole numbers
            least, most = -(-low * score // 100), high * score // 100
            fits = others & (scores >= max(least, LONG.min)) & (scores <= min(most, LONG.max))
            best = first_rows(scores, np.flatnonzero(fits), count)
            same = lambda value: np.full(len(best), value)  # noqa: B023, E731
            found.append((same(block.anchor[k]), same(block.own[k]), same(positive["positive_id"]), same(score),
                          same(positive["place"]), block.ids[best], scores[best]))
    return _table(found, _NEGATIVE)


def hard_negatives(vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", scale: int = SCALE, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, row_bytes: int = ROW_BYTES,
                   anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the
    rows that ``is_anchor`` (over ``id`` and ``label``)."""
    v = F.col(vector_col).cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
            .where("id is not null and label is not null and v is not null").where(F.forall("v", fine)).distinct()
            .withColumn("row", F.monotonically_increasing_id()))
    rows = saved(rows, "vectors")
    total, length = rows.agg(F.count("id"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    asked = rows.where(is_anchor).select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"),
                                         F.col("label").alias("anchor_label"), F.col("v").alias("anchor_v"))
    blocks = lambda count, size: max(1, -(-count * max(length, 1) * 8 // size))
    row_blocks, anchor_blocks = blocks(total, row_bytes), blocks(asked.count(), anchor_bytes)
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    copied = rows.withColumn("p", part("row", row_blocks)).withColumn("q", every(anchor_blocks)).groupBy("p", "q")

    def meet(anchors: DataFrame, work, schema: str) -> DataFrame:
        dealt = anchors.withColumn("q", part("anchor", anchor_blocks)).withColumn("p", every(row_blocks))
        return copied.cogroup(dealt.groupBy("p", "q")).applyInArrow(work, schema)

    found = meet(asked, lambda a, b: _best_positives(a, b, positives, scale),
                 "anchor bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    chosen = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    listed = chosen.groupBy("anchor").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("positives"))
    asked = saved(asked.join(listed, "anchor"), "anchors")
    found = meet(asked, lambda a, b: _best_negatives(a, b, negatives, low, high, scale),
                 "anchor bigint, anchor_id bigint, positive_id bigint, positive_score bigint, place int, "
                 "negative_id bigint, negative_score bigint")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def oracle_sql() -> str:
    """For the registered query: every hundredth row asks, every seventh has a wrong label."""
    return f"""
    WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_dot_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
    SELECT anchor_id, positive_id,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
        id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
    QUALIFY rank <= {NEGATIVES}"""
