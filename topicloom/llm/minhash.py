"""Near duplicates by MinHash: banding, signature check, exact check, connected components.

*Sets.* Letters A-Z are lower-cased, words are runs of anything but ASCII white space. A
text's set holds its different shingles of five words (fewer words: the whole sequence
as one). Shingles are 64-bit numbers, sums of the words' XXH64 times odd constants.
Texts with equal sets, told by 128 bits of digest, are one node: copies are never compared.

*Signatures.* ``HASHES`` minima of (a x + b) mod 2^64 >> 32, which is universal for
32-bit x. Every ``ROWS`` minima are a band, texts that share a band meet in a bucket. At
similarity 0.85, 32 bands of 4 miss a pair with probability 6e-11. Pairs of a bucket
must agree in so many minima that a similar pair fails with probability 1e-9 (six
standard errors), and one set may not be too small for the other; then both full
sets are compared.

*Pairs.* Not all pairs of a bucket are made. First each member meets the bucket's first
node; what this links is joined into groups. A second round takes the buckets whose
members are still in several groups and compares members of different groups, in square
blocks of ``BLOCK_ROWS`` members, so that a large bucket is many tasks. Pairs of one
group need no comparison: the result is as if all pairs had been compared.

*Components.* Alternating large-star and small-star until the edges stay the same. All
steps are grouped minima and joins on edges, so no node's neighbours meet in one list.

Texts without words, and null texts, have an empty set and are linked with nothing. Null
ids never name a group; a group without any id has a null ``component_id``. Rows that
repeat an id count as rows of their own. Whole texts are read, other columns are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import batches_of, raw_texts, saved, slices

SHINGLE, SIMILARITY = 5, 0.8
HASHES, ROWS = 128, 4
# Members of one part of a bucket, and the bytes of their sets.
BLOCK_ROWS, BLOCK_BYTES = 512, 16 << 20
# Ids sent to all executors, counted first (32 MB); beyond that a join shuffles.
SEND_ROWS = 4_000_000
# Different words whose hash a task remembers.
REMEMBERED = 1 << 20

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RANDOM.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2)
_LOWER = bytes(range(256)).lower()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all of a 64-bit number."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    """Hashes of words, computed when first asked for."""

    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        found = self[word] = self.digest(word)
        return found


class Shingles:
    """Sets of texts; remembers the hashes of words."""

    def __init__(self, words: int = SHINGLE):
        self.words, self.known = words, _Hashes()

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def of(self, text: bytes) -> np.ndarray:
        """The different shingles of a text, sorted."""
        parts = [self._hashes(part.split()) for part in slices(_blanks(text))]
        hashes = np.concatenate(parts) if len(parts) > 1 else parts[0]
        if not len(hashes):
            return hashes
        size = min(self.words, len(hashes))
        total = np.full(len(hashes) - size + 1, size, np.uint64)
        for k in range(size):
            total += hashes[k : len(hashes) - size + 1 + k] * _FACTORS[k]
        return np.unique(mixed(total))


def _blanks(text: bytes) -> bytes:
    return text.translate(_LOWER)


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """The least of each hash function's values, as 32-bit numbers."""
    low = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    a, b = _A[:hashes, None], _B[:hashes, None]
    narrow = shingles & np.uint64(0xFFFFFFFF)
    space = np.empty((hashes, min(len(narrow), 4096)), np.uint64)
    for at in range(0, len(narrow), 4096):
        some = narrow[at : at + 4096]
        values = np.multiply(a, some, out=space[:, : len(some)])
        values += b
        np.minimum(low, values.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def least_agreement(similarity: float, hashes: int) -> int:
    """Minima in which a pair of that similarity agrees but for a chance of 1e-9."""
    spread = np.sqrt(hashes * similarity * (1 - similarity))
    return max(0, int(np.floor(hashes * similarity - 6 * spread)))


def marked_texts(docs: DataFrame, hashes: int, id_col: str, text_col: str) -> DataFrame:
    """Each row's id and text with a number, the size and digest of its set and, if the
    set is not empty, its signature."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            sizes, digests, signatures = [], np.zeros((batch.num_rows, 2), np.uint64), []
            for k, text in enumerate(raw_texts(batch.column(2))):
                found = shingles.of(text)
                sizes.append(len(found))
                if len(found):
                    digests[k] = found.sum(), np.bitwise_xor.reduce(mixed(found + _FACTORS[63]))
                signatures.append(signature(found, hashes).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests[:, 0].view(np.int64)),
                 pa.array(digests[:, 1].view(np.int64)), pa.array(signatures, pa.binary())],
                ["row", "id", "text", "size", "d1", "d2", "sig"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        mark, f"row bigint, id {kind}, text string, size bigint, d1 bigint, d2 bigint, sig binary")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Signatures of equal length as rows."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint32).reshape(len(column), -1)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each row and band; bands of different place never share one."""
    bands = signatures.shape[1] // rows
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = mixed(key * _FACTORS[k] + parts[:, :, k])
    return key


def in_buckets(nodes: DataFrame, rows: int) -> DataFrame:
    """``key, band, node, size``: the buckets of each node."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(node), 2048):
                keys = band_keys(_matrix(batch.column(2).slice(at, 2048)), rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)),
                     pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))),
                     pa.array(np.repeat(node[at : at + 2048], keys.shape[1])),
                     pa.array(np.repeat(size[at : at + 2048], keys.shape[1]))], ["key", "band", "node", "size"])

    return nodes.select("node", "size", "sig").mapInArrow(deal, "key bigint, band int, node bigint, size bigint")


def _agreement(one: Column, two: Column) -> Column:
    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array((_matrix(left) == _matrix(right)).sum(1).astype(np.int32))

    return F.arrow_udf(compare, "int")(one, two)


def promising(pairs: DataFrame, nodes: DataFrame, percent: int, least: int) -> DataFrame:
    """``a, b`` pairs of nodes whose signatures and sizes do not speak against a link."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("sig").alias(f"{x}_sig"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = 100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")
    return both.where(fits).where(_agreement(F.col("a_sig"), F.col("b_sig")) >= least).select("a", "b")


def _in_common(one: Column, two: Column) -> Column:
    def count(left: pa.Array, right: pa.Array) -> pa.Array:
        found = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                 for a, b in zip(left.to_pylist(), right.to_pylist())]
        return pa.array(found, pa.int64())

    return F.arrow_udf(count, "bigint")(one, two)


def full_sets(nodes: DataFrame, marked: DataFrame, send_rows: int) -> DataFrame:
    """``row, size, shingles`` of some nodes, which are numbers of rows."""
    needed = saved(nodes.toDF("row").distinct(), "needed")
    few = needed.limit(send_rows + 1).count() <= send_rows

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            sets = [shingles.of(text) for text in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["row", "size", "shingles"])

    texts = marked.select("row", "text").join(F.broadcast(needed) if few else needed, "row", "left_semi")
    return saved(texts.mapInArrow(shingled, "row bigint, size bigint, shingles binary"), "sets")


def confirmed(pairs: DataFrame, marked: DataFrame, percent: int, send_rows: int) -> DataFrame:
    """``a, b`` pairs (stored) whose full sets are similar."""
    sets = full_sets(pairs.select("a").union(pairs.select("b")), marked, send_rows)
    side = lambda x: sets.select(F.col("row").alias(x), F.col("size").alias(f"{x}_size"), F.col("shingles").alias(f"{x}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", _in_common(F.col("a_set"), F.col("b_set")))
    union = F.col("a_size") + F.col("b_size") - F.col("common")
    return both.where(100 * F.col("common") >= percent * union).select("a", "b")


# --- connected components ---------------------------------------------------------

def _edges(edges: DataFrame) -> DataFrame:
    """From larger to smaller node, once each."""
    one, two = edges.columns
    return (edges.where(F.col(one) != F.col(two))
            .select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v")).distinct())


def large_star(edges: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to the least of the node and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for all linked nodes: the smallest node connected with each."""
    edges = saved(_edges(links), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, edges = state, saved(small_star(large_star(edges)), "edges")
    return edges.toDF("node", "label").union(edges.select("v", "v").distinct())


# --- the second round -----------------------------------------------------------------

_PLACE = "key bigint, one int, two int, part int, node bigint, label bigint"


def open_buckets(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Members of the buckets of three or more that are in several groups, once for each
    pair of parts they belong to. (Both members of a bucket of two have met.)"""
    labelled = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = F.greatest(F.ceil(F.count("node") / block_rows), F.ceil(8 * F.sum("size") / block_bytes)).cast("int")
    still = (labelled.groupBy("key").agg(parts.alias("parts"), F.count("node").alias("rows"), F.min("label").alias("l1"),
                                         F.max("label").alias("l2"))
             .where("rows > 2 and l1 != l2").select("key", "parts"))
    members = labelled.join(still, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return members.join(nodes.select("node", "sig"), "node").select(
        "key", "band", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "node",
        "label", "size", "sig")


class _Members:
    """Members of one bucket, or of two of its parts, by size of their sets."""

    def __init__(self, table: pa.Table, percent: int):
        size = table.column("size").to_numpy()
        order = np.argsort(size, kind="stable")
        self.table, self.size = table.take(pa.array(order)), size[order]
        self.node, self.label, self.part = (self.table.column(c).to_numpy() for c in ("node", "label", "part"))
        self.within = table.column("one")[0].as_py() == table.column("two")[0].as_py()
        # Who may be similar to k and is not smaller follows it, up to a bound.
        self.last = np.searchsorted(self.size * percent, 100 * self.size, "right")

    def others(self, k: int, label: np.ndarray) -> np.ndarray:
        """Whether each of those after k that may be similar is of another group. Members of
        one part meet in the task that has this part only."""
        after = slice(k + 1, self.last[k])
        return (label[after] != label[k]) & ((self.part[after] != self.part[k]) | self.within)


def with_partners(members: DataFrame, least: int, rows: int, percent: int) -> DataFrame:
    """Those members whose signature is near that of a member of another group. A pair
    counts in its first common band only."""

    def compare(table: pa.Table) -> pa.Table:
        own = _Members(table, percent)
        signatures, band = _matrix(own.table.column("sig")), table.column("band")[0].as_py()
        bands = signatures.shape[1] // rows
        found = np.zeros(len(own.node), bool)
        for k in range(len(own.node)):
            others = k + 1 + np.flatnonzero(own.others(k, own.label))
            if len(others):
                agree = signatures[others] == signatures[k]
                enough = agree.sum(1) >= least
                others, agree = others[enough], agree[enough, : bands * rows]
                others = others[agree.reshape(len(others), bands, rows).all(2).argmax(1) == band]
                found[others] = True
                found[k] |= len(others) > 0
        return own.table.filter(pa.array(found)).select(["key", "one", "two", "part", "node", "label"])

    return members.groupBy("key", "one", "two").applyInArrow(compare, _PLACE)


def linked_members(members: DataFrame, percent: int) -> DataFrame:
    """``a, b`` links between members of different groups by their full sets. Members that a
    task has already joined, directly or through others, are not linked once more: a task
    returns fewer links than it has members."""

    def compare(table: pa.Table) -> pa.Table:
        own, found = _Members(table, percent), []
        _, label = np.unique(own.label, return_inverse=True)
        sets = [np.frombuffer(s, np.uint64) for s in own.table.column("shingles").to_pylist()]
        _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(own.size)])
        here = np.zeros(int(shingle.max()) + 1, bool)
        for k in range(len(sets)):
            last = own.last[k]
            if not own.others(k, label).any():
                continue
            mine = shingle[starts[k] : starts[k + 1]]
            here[mine] = True
            common = np.add.reduceat(here[shingle[starts[k + 1] : starts[last]]].astype(np.int64),
                                     starts[k + 1 : last] - starts[k + 1])
            here[mine] = False
            union = own.size[k] + own.size[k + 1 : last] - common
            near = own.others(k, label) & (100 * common >= percent * union)
            for other in k + 1 + np.flatnonzero(near):
                if label[other] != label[k]:
                    label[label == label[other]] = label[k]
                    found.append((own.node[k], own.node[other]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return members.groupBy("key", "one", "two").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    hashes: int = HASHES, rows: int = ROWS, block_rows: int = BLOCK_ROWS,
                    block_bytes: int = BLOCK_BYTES, send_rows: int = SEND_ROWS) -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``, the smallest id of
    the documents linked with it directly or through others, itself included."""
    spark, percent, least = docs.sparkSession, round(100 * similarity), least_agreement(similarity, hashes)
    with batches_of(spark):
        marked = saved(marked_texts(docs, hashes, id_col, text_col), "marked")
        full = marked.where("size > 0")
        nodes = saved(full.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("id").alias("least_id"),
                                                   F.first("size").alias("size"), F.first("sig").alias("sig")), "nodes")
        buckets = in_buckets(nodes, rows)
        shared = buckets.groupBy("key").agg(F.min("node").alias("first"), F.count("node").alias("n")).where("n > 1")
        buckets = saved(buckets.join(shared.select("key", "first"), "key"), "buckets")
        met = buckets.where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
        met = saved(promising(met, nodes, percent, least), "met")
        groups = components(saved(confirmed(met, marked, percent, send_rows), "links"))
        members = open_buckets(buckets, groups, nodes, block_rows, block_bytes)
        members = saved(with_partners(members, least, rows, percent), "partners")
        if not members.isEmpty():
            sets = full_sets(members.select("node"), marked, send_rows).withColumnRenamed("row", "node")
            links = saved(linked_members(members.join(sets, "node"), percent), "links")
            groups = components(groups.union(links))
    labelled = saved(nodes.drop("sig", "size").join(groups, "node", "left")
                     .withColumn("label", F.coalesce("label", "node")), "labelled")
    named = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    names = labelled.join(named, "label").select("d1", "d2", "component_id")
    own = marked.select("id", "size", "d1", "d2").join(names, ["d1", "d2"], "left")
    return own.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                      F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def oracle_sql(percent: int) -> str:
    return f"""
    WITH RECURSIVE t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT row, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS shingle
        FROM t),
    n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
    c AS (SELECT a.row AS a, b.row AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.row <> b.row GROUP BY ALL),
    links AS (SELECT a, b FROM c JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
    reach(a, b) AS (SELECT row, row FROM t UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    named AS (SELECT reach.a AS row, min(t.doc_id) AS component_id FROM reach JOIN t ON t.row = reach.b GROUP BY reach.a)
    SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
    FROM t JOIN named USING (row) LEFT JOIN n USING (row)"""
