"""Near duplicates: 64-bit SimHash fingerprints joined with themselves over a binary trie.

*Fingerprint.* Letters A-Z are lower-cased, words are runs of anything but ASCII white
space, shingles are three words joined by a space, repeats included (fewer words: the
whole sequence). A bit is 1 if over half of the shingles' XXH64 values (seed 42) have it.

*Links.* Texts with equal fingerprints are linked without comparing them; the distinct
fingerprints form a binary trie. Its upper part is cut, from counts by prefix, into
nodes of at most ``leaf_rows`` fingerprints. Pairs of nodes are traversed together from
the root: each step down adds the bit in which the two differ, and a pair is dropped
when it exceeds the error budget. Surviving node pairs are the tasks; within a task the
traversal goes on, level by level over sorted arrays, until few fingerprints are left
to compare outright. A node has at most 1 + d + d(d-1)/2 partners at depth d for a
budget of 2, so no group of look-alikes, however large, makes the work quadratic.

*Groups.* A task returns its fingerprints with the smallest one of their local group,
not its links. Local groups that share a fingerprint are merged by contraction: each
takes the neighbour with the smallest hash as parent, until no edge is left; every
round is a table in the shared folder.

Null, empty and blank texts have fingerprint 0 and are linked like any other. Documents
without an id get a group; only ids that are not null can name one. Repeated rows stay
rows. Texts are hashed whole; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import saved

SHINGLE, BUDGET, SEED = 3, 2, 42
LEAF_ROWS = 65_536
BITS = 64
# Node pairs whose product of sizes is at most this are compared outright.
OUTRIGHT = 16
# Node pairs worked on at a time.
FRONTIER = 500_000
# Numbers of rows sent to all executors, counted first (32 MB).
SEND_ROWS = 4_000_000


def fingerprint_of(text: str | None) -> int:
    """SimHash of one text, as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % three, SEED) for three in zip(words, words[1:], words[2:])]
    values = np.array(hashes, "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 65_536):
        bits = np.unpackbits(values[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(values), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprint(text: Column) -> Column:
    """Fingerprints of a text column, as signed 64-bit integers."""

    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint_of(t) for t in batch.to_pylist()], pa.int64())

    return F.arrow_udf(compute, "bigint").asNondeterministic()(text)


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# --- the upper part of the trie -------------------------------------------------

Leaf = tuple[int, int]  # depth, prefix


def trie_leaves(prints: DataFrame, leaf_rows: int, step: int = 10) -> list[Leaf]:
    """Cut the trie of distinct fingerprints into nodes of at most ``leaf_rows``.

    The driver sees counts by prefix only: those of nodes that are still too large are
    refined by ``step`` bits at a time, neighbours that are small stay together.
    """
    leaves: list[Leaf] = []
    large: list[Leaf] = [(0, 0)]
    while large:
        depth = large[0][0]
        deeper = min(depth + step, BITS)
        inside = F.shiftrightunsigned("fp", BITS - depth).isin([p for _, p in large]) if depth else F.lit(True)
        prefix = F.shiftrightunsigned("fp", BITS - deeper) if deeper < BITS else F.col("fp")
        counts = {int(r[0]) & (2**BITS - 1): r[1]
                  for r in prints.where(inside).groupBy(prefix.alias("p")).count().collect()}
        large = [_split(node, deeper, counts, leaf_rows, leaves) for node in large]
        large = [leaf for more in large for leaf in more]
    return sorted(leaves, key=lambda leaf: leaf[1] << (BITS - leaf[0]))


def _split(node: Leaf, deeper: int, counts: dict[int, int], leaf_rows: int, leaves: list[Leaf]) -> list[Leaf]:
    """Leaves below ``node`` go to ``leaves``; returns nodes at ``deeper`` still too large."""
    sums = {deeper: counts}
    for depth in range(deeper - 1, node[0] - 1, -1):
        level: dict[int, int] = {}
        for prefix, rows in sums[depth + 1].items():
            level[prefix >> 1] = level.get(prefix >> 1, 0) + rows
        sums[depth] = level
    large, todo = [], [node]
    while todo:
        depth, prefix = todo.pop()
        rows = sums[depth].get(prefix, 0)
        if rows <= leaf_rows or depth == BITS:
            leaves.append((depth, prefix))
        elif depth == deeper:
            large.append((depth, prefix))
        else:
            todo += [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
    return large


def node_pairs(leaves: list[Leaf], budget: int) -> list[tuple[int, int]]:
    """Pairs of leaves (by position) that may hold links: both walked down together."""
    number = {leaf: k for k, leaf in enumerate(leaves)}
    found: list[tuple[int, int]] = []
    todo: list[tuple[Leaf, Leaf]] = [((0, 0), (0, 0))]

    def below(node: Leaf) -> list[Leaf]:
        depth, prefix = node
        return [node] if node in number else [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]

    while todo:
        one, two = todo.pop()
        if one in number and two in number:
            found.append((number[one], number[two]))
            continue
        steps = [(a, b) for a in below(one) for b in below(two)]
        if one == two:
            steps.remove((steps[1][1], steps[1][0]))  # the two children meet once
        todo += [(a, b) for a, b in steps if _difference(a, b) <= budget]
    return found


def _difference(one: Leaf, two: Leaf) -> int:
    """Bits in which the shared length of two prefixes differs."""
    depth = min(one[0], two[0])
    return ((one[1] >> (one[0] - depth)) ^ (two[1] >> (two[0] - depth))).bit_count()


# --- within a task ------------------------------------------------------------

class Groups:
    """Union-find over positions, by arrays."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def link(self, one: np.ndarray, two: np.ndarray) -> None:
        while len(one):
            a, b = self.label[one], self.label[two]
            apart = a != b
            if not apart.any():
                return
            one, two, a, b = one[apart], two[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = self.label[self.label]
                if np.array_equal(jumped, self.label):
                    break
                self.label = jumped


def traverse(values: np.ndarray, starts: tuple[int, int, int, int], budget: int, groups: Groups) -> None:
    """Link positions of sorted ``values`` (unsigned) within the ranges [lo1, hi1) and
    [lo2, hi2), which are one node or two nodes next to each other."""
    todo = [(0, np.array([starts], np.int64), np.zeros(1, np.int64))]
    while todo:
        depth, nodes, errors = todo.pop()
        if len(nodes) > FRONTIER:
            todo += [(depth, nodes[k : k + FRONTIER], errors[k : k + FRONTIER])
                     for k in range(0, len(nodes), FRONTIER)]
            continue
        sizes = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        small = (sizes <= OUTRIGHT) | (depth == BITS)
        _compare(values, nodes[small], sizes[small], budget, groups)
        nodes, errors = nodes[~small], errors[~small]
        if not len(nodes):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        cut1, cut2 = (np.searchsorted(values, (values[nodes[:, k]] & ~(bit | (bit - np.uint64(1)))) | bit)
                      for k in (0, 2))
        cut1, cut2 = np.clip(cut1, nodes[:, 0], nodes[:, 1]), np.clip(cut2, nodes[:, 2], nodes[:, 3])
        same = (nodes[:, 0] == nodes[:, 2]) & (nodes[:, 1] == nodes[:, 3])
        low1, high1 = (nodes[:, 0], cut1), (cut1, nodes[:, 1])
        low2, high2 = (nodes[:, 2], cut2), (cut2, nodes[:, 3])
        next_nodes, next_errors = [], []
        for one, two, more, twice in ((low1, low2, 0, False), (high1, high2, 0, False),
                                      (low1, high2, 1, False), (high1, low2, 1, True)):
            keep = (one[0] < one[1]) & (two[0] < two[1]) & (errors + more <= budget)
            if twice:
                keep &= ~same
            next_nodes.append(np.stack([*one, *two], axis=1)[keep])
            next_errors.append(errors[keep] + more)
        todo.append((depth + 1, np.concatenate(next_nodes), np.concatenate(next_errors)))


def _compare(values: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, budget: int, groups: Groups) -> None:
    for at in range(0, len(nodes), 65_536):
        some, size = nodes[at : at + 65_536], sizes[at : at + 65_536]
        owner = np.repeat(np.arange(len(some)), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        width = (some[:, 3] - some[:, 2])[owner]
        one, two = some[owner, 0] + inside // width, some[owner, 2] + inside % width
        near = np.bitwise_count(values[one] ^ values[two]) <= budget
        groups.link(one[near], two[near])


def local_groups(first: np.ndarray, second: np.ndarray | None, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of one node (``second`` is None) or of two with the smallest of
    their group, for groups of at least two."""
    first = np.unique(first.astype(np.uint64))
    if second is None:
        values, starts = first, (0, len(first), 0, len(first))
    else:
        second = np.unique(second.astype(np.uint64))
        values = np.concatenate([first, second])
        order = np.argsort(values, kind="stable")
        values = values[order]
        at = np.flatnonzero(order < len(first)), np.flatnonzero(order >= len(first))
        if not len(at[0]) or not len(at[1]):
            return values[:0], values[:0]
        starts = (int(at[0][0]), int(at[0][-1]) + 1, int(at[1][0]), int(at[1][-1]) + 1)
    groups = Groups(len(values))
    traverse(values, starts, budget, groups)
    linked = np.bincount(groups.label, minlength=len(values))[groups.label] > 1
    return values[linked], values[groups.label[linked]]


# --- the join ---------------------------------------------------------------------

def linked_prints(prints: DataFrame, *, budget: int = BUDGET, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``fp, root`` of fingerprints within ``budget`` bits of another; a fingerprint can
    have several roots, one for each task that found a partner."""
    leaves = trie_leaves(prints, leaf_rows)
    pairs = node_pairs(leaves, budget)
    starts = np.array([prefix << (BITS - depth) for depth, prefix in leaves], np.uint64)
    sides = sorted([(a, k, 0) for k, (a, b) in enumerate(pairs)] + [(b, k, 1) for k, (a, b) in enumerate(pairs) if a != b])
    of_leaf = np.array(sides, np.int64).reshape(-1, 3)
    firsts = np.searchsorted(of_leaf[:, 0], np.arange(len(leaves) + 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            leaf = np.searchsorted(starts, values.view(np.uint64), "right") - 1
            for at in range(0, len(values), 8192):
                some = leaf[at : at + 8192]
                copies = firsts[some + 1] - firsts[some]
                row = np.repeat(np.arange(len(some)), copies)
                entry = firsts[some][row] + np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of_leaf[entry, 1].astype(np.int32)), pa.array(of_leaf[entry, 2].astype(np.int8)),
                     pa.array(values[at : at + 8192][row])], ["pair", "side", "fp"])

    def search(table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        side = table.column("side").to_numpy()
        pair = pairs[table.column("pair")[0].as_py()]
        found, roots = local_groups(values[side == 0], None if pair[0] == pair[1] else values[side == 1], budget)
        return pa.table({"fp": found.view(np.int64), "root": roots.view(np.int64)})

    return (prints.select("fp").mapInArrow(deal, "pair int, side tinyint, fp bigint")
            .groupBy("pair").applyInArrow(search, "fp bigint, root bigint"))


def merged_groups(links: DataFrame) -> DataFrame:
    """``fp, label``: one label for all that ``fp``-``root`` links connect."""
    links = saved(links.distinct(), "links")
    least = links.groupBy("fp").agg(F.min("root").alias("root"))
    # Two local groups meet where one fingerprint has both roots.
    edges = saved(links.join(least.withColumnRenamed("root", "least"), "fp").where("root != least")
                  .select(F.col("root").alias("a"), F.col("least").alias("b")).distinct(), "edges")
    label = least
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        parents = saved(both.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a")))["v"].alias("parent")),
                        "parents")
        moved = label.join(parents.withColumnRenamed("a", "root"), "root", "left")
        label = saved(moved.select("fp", F.coalesce("parent", "root").alias("root")), "labels")
        edges = saved(edges.join(parents.toDF("a", "pa"), "a").join(parents.toDF("b", "pb"), "b")
                      .where("pa != pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
                      .distinct(), "edges")
    return label.withColumnRenamed("root", "label")


def named_prints(marked: DataFrame, budget: int = BUDGET, leaf_rows: int = LEAF_ROWS, id_col: str = "doc_id") -> DataFrame:
    """``fp, label, component_id`` of the fingerprints of a stored table: ``label`` tells
    groups apart, ``component_id`` is the smallest id of a group."""
    prints = saved(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")), "prints")
    groups = merged_groups(linked_prints(prints, budget=budget, leaf_rows=leaf_rows))
    labelled = saved(prints.join(groups, "fp", "left")
                     .select("fp", "least_id", F.coalesce("label", "fp").alias("label")), "groups")
    # Only fingerprints of groups of several need their group's smallest id looked up.
    named = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    return labelled.join(named, "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET,
                    leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row per document: its id, ``fp`` and ``component_id``, the smallest id in its
    group of documents linked directly or through others (null if none has an id)."""
    marked = saved(docs.select(F.col(id_col), fingerprint(F.col(text_col)).alias("fp")), "fingerprints")
    names = named_prints(marked, budget, leaf_rows, id_col).drop("label")
    return marked.join(names, "fp").select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                send_rows: int = SEND_ROWS) -> DataFrame:
    """``docs`` without near duplicates: one row of each group stays, that with the smallest
    id, of several such rows or of a group without ids the first stored.

    Rows are told apart by a number of their own, so rows of one id with texts that are
    not alike all stay, and no column of ``docs`` plays a part besides id and text. Which
    rows stay is found on narrow rows; texts are shuffled only if more than ``send_rows``
    stay.
    """
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    marked = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                               fingerprint(F.col(text_col)).alias("fp"), whole.alias("doc")), "fingerprints")
    names = named_prints(marked, id_col="id").select("fp", "label")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row"))["row"]
    stay = saved(marked.select("row", "id", "fp").join(names, "fp").groupBy("label").agg(first.alias("row")).select("row"), "stay")
    few = stay.limit(send_rows + 1).count() <= send_rows
    kept = marked.join(F.broadcast(stay) if few else stay, "row", "left_semi")
    return kept.select(*[F.col(f"doc.c{k}").alias(c) for k, c in enumerate(docs.columns)])
