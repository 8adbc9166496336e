"""Phrase collocation mining by set-oriented relational mining (SETM).

*Occurrence relations.* R_k holds where a frequent phrase of k words begins: position
and phrase id, sorted by position, stored in the shared folder. Its rows are blocks of
whole texts of one language, so that occurrences that can be neighbours are in one row.
A piece boundary takes up a position of its own: positions that follow each other are
in the same piece.

*Extending.* R_k is merge-joined with itself on piece and adjacent position: phrase p at
i and phrase q at i+1 make a phrase of k+1 words, known by the ids (p, q). Each block
counts its different pairs, a task sums those of its blocks and packs the sums, with few
bytes for a pair, by part. All sums of a pair are of one part, where they are summed up and
those below ``min_count`` go; the semi-join of the blocks' pairs with the frequent groups
gives R_{k+1}, which takes the place of R_k. A phrase whose first or last k words are not
frequent cannot be frequent and is never counted. Ids are exact; a hash of them only says
which part sums up a pair.

*Scores.* Cuts of a phrase are joined with the counts of both parts; the arithmetic is
in whole decimals of 38 digits. If a phrase lies inside a longer one that is (nearly) as
frequent, it lies inside one longer by a single word that is too, so only phrases one
word longer need to be looked at.

Letters A-Z are lower-cased; ``[.,;:!?\\x0A-\\x0D]`` ends a piece; words are runs of
anything but blank and tab. Null texts are empty and give no words, a null language
counts as ``und``. Repeated rows each count. Very long texts are read in parts and form
one block. Only the language and the text column are looked at, so other columns may
have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import batches_of, raw_texts, saved, slices
from topicloom.session import drop_path, work_path

UNKNOWN = "und"
MAX_WORDS, MIN_COUNT, TOP, ABSORBED = 5, 100, 2000, 100
# Bytes of text of all languages that a task gathers before it stores them as blocks.
BLOCK_BYTES = 3 << 20
# Frequent groups are sent to the executors up to so many rows, of three numbers (24 MB) or
# of a word and one, counted first; beyond that both sides are shuffled.
SEND_ROWS = 1_000_000
# Pairs of ids that a task hands over at a time.
PAIR_ROWS = 65_536
# Counts of pairs that a task gathers before it sums them; sums of more than half of it go.
HELD_ROWS = 1 << 19
# Words of all texts for each part of the pairs: at most so many counts meet in a part.
PART_WORDS = 1 << 21
# Blocks that a scan decodes at a time.
SCAN_ROWS = 8
# Bytes of an Arrow batch, a row at least.
HANDED_BYTES = 2 << 20

BOUNDARY = b"."
_PLAIN = bytes(range(256)).lower()
# Every character that ends a piece becomes the boundary, a tab becomes a blank.
_TRANSLATED = _PLAIN.translate(bytes.maketrans(b",;:!?\x0a\x0b\x0c\x0d\x09", b"." * 9 + b" "))


class _Block:
    """Texts of one language: words by number, 0 for a piece boundary."""

    def __init__(self):
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.words[BOUNDARY] = 0
        self.codes: list[np.ndarray] = []

    def add(self, text: bytes) -> None:
        for part in slices(text.translate(_TRANSLATED)):
            tokens = part.replace(BOUNDARY, b" . ").split()
            self.codes.append(np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens)))
        self.codes.append(np.zeros(1, np.int32))

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        # The factory holds the words that hold it: left so, they stay until cycles are searched.
        self.words.default_factory = None
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes, minlength=len(self.words))[1:]
        words = pa.array(list(self.words)[1:], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([lang]), pa.array([int(counts.sum())], pa.int64()),
             pa.ListArray.from_arrays([0, len(words)], words),
             pa.ListArray.from_arrays([0, len(words)], pa.array(counts, pa.int64())),
             pa.array([codes.tobytes()], pa.binary())],
            ["block", "lang", "total", "words", "counts", "codes"])


def word_blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of ``lang, text`` rows: their words, how often each occurs, and the text as
    numbers of words."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        made, held, blocks = 0, 0, defaultdict(_Block)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                blocks[lang].add(text)
                held += len(text)
                if held >= block_bytes:
                    for k, (name, block) in enumerate(blocks.items()):
                        yield block.row(first + made + k, name)
                    made, held, blocks = made + len(blocks), 0, defaultdict(_Block)
        for k, (name, block) in enumerate(blocks.items()):
            yield block.row(first + made + k, name)

    schema = "block bigint, lang string, total bigint, words array<string>, counts array<bigint>, codes binary"
    return texts.mapInArrow(gather, schema)


_RELATION = "block bigint, steps binary, codes binary, ids binary"
_COLUMNS = ("block", "steps", "codes", "ids")
_COUNTS = ["left", "right", "n"]


def _relation(block: int, at: np.ndarray, ids: np.ndarray) -> pa.Table:
    """A row of sorted positions, as the steps between them, and of ids, by number."""
    some, codes = np.unique(ids, return_inverse=True)
    steps = np.diff(at, prepend=0).astype(np.int32)
    values = (steps.tobytes(), codes.astype(np.int32).tobytes(), some.astype(np.int64).tobytes())
    return pa.table([pa.array([block], pa.int64()), *[pa.array([v], pa.binary()) for v in values]], names=list(_COLUMNS))


def _opened(steps: bytes, codes: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and ids of a row of a relation."""
    return np.cumsum(np.frombuffer(steps, np.int32), dtype=np.int64), np.frombuffer(ids, np.int64)[np.frombuffer(codes, np.int32)]


def _nothing() -> pa.Table:
    return pa.table([pa.array([], pa.int64()), *[pa.array([], pa.binary())] * 3], names=list(_COLUMNS))


def _starts(block: int, codes: bytes, number: np.ndarray, ids: np.ndarray) -> pa.Table:
    """R_1 of a block: where its words of these numbers are, with their ids."""
    codes = np.frombuffer(codes, np.int32)
    of = np.full(max(int(codes.max(initial=0)), int(number.max(initial=0))) + 1, -1, np.int64)
    of[number] = ids
    at = np.flatnonzero(of[codes] >= 0)
    return _relation(block, at, of[codes[at]])


def first_relation(key: tuple, texts: pa.Table, frequent: pa.Table) -> pa.Table:
    """R_1 of a block: its words that are frequent, with their ids."""
    if not len(texts) or not len(frequent):
        return _nothing()
    number, ids = (frequent.column(c).to_numpy() for c in ("number", "id"))
    return _starts(key[0].as_py(), texts.column("codes")[0].as_py(), number, ids)


def starts(blocks: DataFrame, listed: DataFrame, words: DataFrame, send_rows: int) -> DataFrame:
    """R_1. Few frequent words (stored, counted first) go to the tasks, which then read the
    blocks where they are; many are joined with the words of each block and brought to it."""
    known = words.select("lang", "phrase", "id")
    if words.select(F.lit(1)).limit(send_rows + 1).count() > send_rows:
        of_block = listed.join(known, ["lang", "phrase"]).select(F.col("block").alias("home"), "number", "id")
        return (blocks.select("block", "codes").groupBy("block").cogroup(of_block.groupBy("home"))
                .applyInArrow(first_relation, _RELATION))
    table = known.toArrow()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_lang = {}
        for lang in pc.unique(table.column("lang")).to_pylist():
            own = table.filter(pc.field("lang") == lang)
            of_lang[lang] = own.column("phrase").combine_chunks(), own.column("id").to_numpy()
        for batch in batches:
            for block, lang, names, codes in zip(*(batch.column(c) for c in ("block", "lang", "words", "codes"))):
                if lang.as_py() in of_lang:
                    phrases, ids = of_lang[lang.as_py()]
                    place = pc.index_in(names.values, phrases).fill_null(-1).to_numpy()
                    number = np.flatnonzero(place >= 0)
                    yield from _starts(block.as_py(), codes.as_py(), number + 1, ids[place[number]]).to_batches()

    return blocks.select("block", "lang", "words", "codes").mapInArrow(look_up, _RELATION)


def neighbours(at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge-join of a sorted relation with itself on adjacent positions: where the
    first of both is, and both ids."""
    first = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[first], ids[first], ids[first + 1]


def _pair_keys(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids as single numbers below the square of the block's different ids."""
    some = np.unique(np.concatenate([left, right]))
    return np.searchsorted(some, left) * np.int64(len(some)) + np.searchsorted(some, right), some


def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, left, right, n``: how often each pair of neighbours occurs in a block."""
    for batch in batches:
        for block, *row in zip(*(batch.column(c) for c in _COLUMNS)):
            block = block.as_py()
            _, left, right = neighbours(*_opened(*(value.as_py() for value in row)))
            keys, some = _pair_keys(left, right)
            keys, counts = np.unique(keys, return_counts=True)
            for k in range(0, len(keys), PAIR_ROWS):
                part = keys[k : k + PAIR_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), block)), pa.array(some[part // len(some)]),
                     pa.array(some[part % len(some)]), pa.array(counts[k : k + PAIR_ROWS])],
                    ["block", "left", "right", "n"])


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, column by column, those of equal weight among their bytes together:
    small numbers leave most of them zero."""
    planes = [np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(data: bytes, rows: int, columns: int) -> np.ndarray:
    """One line for each of ``columns`` of ``rows`` whole numbers."""
    planes = pa.decompress(data, decompressed_size=8 * rows * columns, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(columns, 8, rows).transpose(0, 2, 1).copy().view("<i8")[..., 0]


def part_of(left: np.ndarray, right: np.ndarray, parts: int) -> np.ndarray:
    """The part in which a pair of ids is summed up."""
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _sums(counts: list[pa.RecordBatch]) -> pa.Table:
    """``left, right, n`` of each different pair."""
    left, right, n = (np.concatenate([batch.column(k).to_numpy() for batch in counts]) for k in range(3))
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.flatnonzero((np.diff(left, prepend=-1) != 0) | (np.diff(right, prepend=-1) != 0))
    summed = np.add.reduceat(n[order], first) if len(n) else n
    return pa.table([pa.array(left[first]), pa.array(right[first]), pa.array(summed)], names=_COUNTS)


def _by_part(sums: pa.Table, parts: int) -> Iterator[pa.RecordBatch]:
    left, right, n = (sums.column(c).to_numpy() for c in ("left", "right", "n"))
    part = part_of(left, right, parts)
    order = np.lexsort((left, part))
    part, left, right, n = part[order], left[order], right[order], n[order]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(part)]):
        data = packed(np.diff(left[a:b], prepend=0), right[a:b], n[a:b])
        yield pa.RecordBatch.from_arrays([pa.array([part[a]]), pa.array([b - a], pa.int64()), pa.array([data], pa.binary())],
                                         ["part", "rows", "pairs"])


def sliced_sums(table: pa.Table, parts: int, held_rows: int) -> Iterator[pa.Table]:
    """``left, right, n`` of each different pair of a part. The part is unpacked several times,
    each time for the pairs of one slice, so that about ``held_rows`` counts are held."""
    rows = table.column("rows").to_pylist()
    passes = sum(rows) // held_rows + 1
    for one in range(passes):
        held = []
        for count, data in zip(rows, table.column("pairs")):
            steps, right, n = unpacked(data.as_py(), count, 3)
            left = np.cumsum(steps)
            own = part_of(left, right, parts * passes) // parts == one
            held.append(pa.RecordBatch.from_arrays([pa.array(column[own]) for column in (left, right, n)], _COUNTS))
        yield _sums(held)


def summed_pairs(relation: DataFrame, parts: int, min_count: int, held_rows: int = HELD_ROWS) -> DataFrame:
    """``left, right, f``: pairs of neighbours that occur ``min_count`` times in all blocks."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for counts in pair_counts(batches):
            held.append(counts.select(_COUNTS))
            rows += len(counts)
            if rows >= held_rows:
                sums = _sums(held)
                held, rows = sums.to_batches(), len(sums)
                if 2 * rows > held_rows:
                    held, rows = [], 0
                    yield from _by_part(sums, parts)
        if rows:
            yield from _by_part(_sums(held), parts)

    def total(table: pa.Table) -> pa.Table:
        found = [slice.filter(pc.field("n") >= min_count) for slice in sliced_sums(table, parts, held_rows)]
        return pa.concat_tables(found).rename_columns({"n": "f"})

    return (relation.mapInArrow(gather, "part bigint, rows bigint, pairs binary").groupBy("part")
            .applyInArrow(total, "left bigint, right bigint, f bigint"))


class FrequentPairs:
    """Ids of pairs, looked up by both parts."""

    def __init__(self, table: pa.Table):
        left, right, ids = (table.column(c).to_numpy() for c in ("left", "right", "id"))
        keys, self.some = _pair_keys(left, right)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are frequent, and the ids of those."""
        one, two = (np.minimum(np.searchsorted(self.some, x), len(self.some) - 1) for x in (left, right))
        keys = one * np.int64(len(self.some)) + two
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = (self.some[one] == left) & (self.some[two] == right) & (self.keys[place] == keys)
        return hit, self.ids[place[hit]]

    def extend(self, block: int, steps: bytes, codes: bytes, ids: bytes) -> pa.Table:
        """The next relation of a block: neighbours that are a frequent pair, with its id."""
        at, left, right = neighbours(*_opened(steps, codes, ids))
        hit, found = self.find(left, right)
        return _relation(block, at[hit], found)


def next_relation(key: tuple, relation: pa.Table, frequent: pa.Table) -> pa.Table:
    """R_{k+1} of a block from R_k and the frequent pairs of this block."""
    if not len(relation) or not len(frequent):
        return _nothing()
    return FrequentPairs(frequent).extend(key[0].as_py(), *(relation.column(c)[0].as_py() for c in _COLUMNS[1:]))


def semi_joined(relation: DataFrame, grouped: DataFrame, send_rows: int) -> DataFrame:
    """R_{k+1} from R_k. Few frequent pairs (stored, counted first) go to the tasks, which
    then read R_k where it is; many are joined with the pairs of each block and brought
    to the block."""
    if grouped.select(F.lit(1)).limit(send_rows + 1).count() > send_rows:
        pairs = relation.mapInArrow(pair_counts, "block bigint, left bigint, right bigint, n bigint")
        of_block = pairs.join(grouped.select("left", "right", "id"), ["left", "right"])
        return (relation.groupBy("block").cogroup(of_block.select("block", "left", "right", "id").groupBy("block"))
                .applyInArrow(next_relation, _RELATION))
    table = grouped.select("left", "right", "id").toArrow()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = FrequentPairs(table)
        for batch in batches:
            for row in zip(*(batch.column(c) for c in _COLUMNS)):
                yield from frequent.extend(*(value.as_py() for value in row)).to_batches()

    return relation.mapInArrow(extend, _RELATION)


def frequent_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS,
                     min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES,
                     send_rows: int = SEND_ROWS) -> tuple[DataFrame, DataFrame]:
    """``lang, n``: words of each language; and ``lang, phrase, words, f``: all phrases of 1
    to ``max_words`` words that occur at least ``min_count`` times."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)), F.coalesce(F.col(text_col), F.lit("")))
    with batches_of(spark, HANDED_BYTES):
        blocks = _Stored(word_blocks(texts, block_bytes), "blocks")
    with batches_of(spark, HANDED_BYTES, SCAN_ROWS):
        return _levels(blocks, max_words, min_count, send_rows)


class _Stored:
    """A table in the shared folder, until what follows from it is stored."""

    def __init__(self, rows: DataFrame, purpose: str):
        spark = rows.sparkSession
        self.path = work_path(spark, f"llm-{purpose}")
        rows.write.parquet(self.path)
        self.rows = spark.read.schema(rows.schema).parquet(self.path)

    def replaced_by(self, rows: DataFrame, purpose: str) -> _Stored:
        """``rows``, made of this table, in its place."""
        stored = _Stored(rows, purpose)
        drop_path(rows.sparkSession, self.path)
        return stored


def _levels(stored: _Stored, max_words: int, min_count: int, send_rows: int) -> tuple[DataFrame, DataFrame]:
    """One level after the other, from words to phrases of ``max_words``."""
    blocks = stored.rows
    totals = saved(blocks.groupBy("lang").agg(F.sum("total").alias("n")).where("n > 0"), "totals")
    parts = (totals.agg(F.sum("n")).first()[0] or 0) // PART_WORDS + 1
    listed = (blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("number", "w"))
              .select("block", "lang", (F.col("number") + 1).alias("number"), F.col("w.words").alias("phrase"),
                      F.col("w.counts").alias("n")))
    words = listed.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    words = saved(words.select(F.monotonically_increasing_id().alias("id"), "lang", "phrase",
                               F.col("phrase").alias("last"), F.lit(1).alias("words"), "f"), "frequent")
    levels = [words]
    stored = stored.replaced_by(starts(blocks, listed, words, send_rows), "occurrences")
    for length in range(2, max_words + 1):
        grouped = summed_pairs(stored.rows, parts, min_count)
        grouped = saved(grouped.withColumn("id", F.monotonically_increasing_id()), "groups")
        if grouped.isEmpty():
            break
        known = levels[-1]
        named = (grouped.join(known.select(F.col("id").alias("left"), "lang", "phrase"), "left")
                 .join(known.select(F.col("id").alias("right"), "last"), "right"))
        levels.append(saved(named.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last",
                                         F.lit(length).alias("words"), "f"), "frequent"))
        if length < max_words:
            stored = stored.replaced_by(semi_joined(stored.rows, grouped, send_rows), "occurrences")
    drop_path(stored.rows.sparkSession, stored.path)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return totals, every.select("lang", "phrase", "words", "f")


def _part(words: Column, start: object, length: object) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS,
                 min_count: int = MIN_COUNT, top: int = TOP, absorbed: int = ABSORBED, block_bytes: int = BLOCK_BYTES,
                 send_rows: int = SEND_ROWS) -> DataFrame:
    """Each language's ``top`` phrases of two words or more: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of the cut with the lowest
    floor(1000 a n / (l r)), ``n`` all words. Phrases of which ``absorbed`` per cent of
    the occurrences lie in one longer frequent phrase are left out. Higher scores come
    first, then higher counts, then phrases in byte order.
    """
    totals, known = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, max_words=max_words,
                                     min_count=min_count, block_bytes=block_bytes, send_rows=send_rows)
    words = F.split("phrase", " ")
    candidates = known.where("words > 1")
    inside = (candidates.where("words > 2")
              .select("lang", F.explode(F.array(_part(words, F.lit(1), F.col("words") - 1),
                                                _part(words, F.lit(2), F.col("words") - 1))).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = (candidates.join(inside, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("f"))))
    cut = F.col("cut")
    cuts = (kept.select("lang", "phrase", "words", F.col("f").alias("a"),
                        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
            .select("lang", "phrase", "a", "cut", _part(words, F.lit(1), cut).alias("first"),
                    _part(words, cut + 1, F.col("words") - cut).alias("rest")))
    counts = known.select("lang", "phrase", "f")
    cuts = (cuts.join(counts.toDF("lang", "first", "l"), ["lang", "first"])
            .join(counts.toDF("lang", "rest", "r"), ["lang", "rest"]).join(totals, "lang"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (whole("a") * whole("n") * F.lit(1000)).cast("decimal(38,0)"), whole("l") * whole("r"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.select("lang", "phrase", "a", "c.l", "c.r", "n", F.col("c.score").alias("score"))
            .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def oracle_sql(max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, absorbed: int = ABSORBED) -> str:
    return f"""
    WITH t AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w
        FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t)),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM p, (SELECT unnest(range(1, {max_words + 1})) AS k)),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {min_count}),
    parts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    longer AS (SELECT lang, phrase, max(a) AS a FROM (
        SELECT lang, a, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase
        FROM parts WHERE k > 2) GROUP BY ALL),
    kept AS (SELECT p.* FROM parts p LEFT JOIN longer o ON o.lang = p.lang AND o.phrase = p.phrase
        WHERE o.a IS NULL OR 100 * o.a < {absorbed} * p.a),
    cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS one, array_to_string(w[j + 1:k], ' ') AS two
        FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
    scored AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n.n, j,
        ((1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.one JOIN f y ON y.lang = c.lang AND y.phrase = c.two
        JOIN n ON n.lang = c.lang),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM best QUALIFY rank <= {top}"""
