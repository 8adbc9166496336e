"""Collocations, MinHash near duplicates and hard negatives against brute force."""

from __future__ import annotations

import gc
import math
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.llm import collocations, minhash, negatives

DOCS = "doc_id long, text string, lang string"
LONG = "word other. " * 60_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clashing(frame):
    names = ["block", "id", "row", "key", "size", "label_", "at", "ids", "words", "f", "n", "node", "band", "part", "a",
             "b", "score", "rank", "p", "q", "component_id", "kept", "phrase"]
    return frame.withColumns({n: F.lit("clash") for n in names if n not in frame.columns})


# --- collocations ---------------------------------------------------------------------

def brute_collocations(rows, least, top=2000, absorbed=100, longest=5):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least}
        inside = Counter()
        for longer, c in often.items():
            for size in range(2, len(longer)):
                for i in range(len(longer) - size + 1):
                    part = longer[i : i + size]
                    inside[part] = max(inside[part], c)
        listed = []
        for phrase, a in often.items():
            if len(phrase) < 2 or (phrase in inside and 100 * inside[phrase] >= absorbed * a):
                continue
            cuts = [(1000 * a * n[lang] // (counts[phrase[:k]] * counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            listed.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def found_collocations(docs, **options):
    return sorted(map(tuple, collocations.collocations(docs, **options).collect()))


def some_texts(count, seed):
    rng = random.Random(seed)
    words = ["Ab", "ab", "c", "é", "Éa", "d", "x\x1cy", " "]
    signs = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", ";c", "?"]
    return ["".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(count)]


@pytest.mark.parametrize(("options", "least"), [({}, 3), ({"block_bytes": 400}, 3), ({"block_bytes": 1000, "send_rows": 0}, 12)])
def test_collocations_equal_brute_force(spark, options, least):
    rng = random.Random(8)
    rows = [(k % 50, t, rng.choice(["en", "fr", None, "und"])) for k, t in enumerate(some_texts(120, 3))]
    rows += [(None, None, "en"), (7, "", None), (8, "a b c d e f " * 5, "long"), (8, "a b c d e f " * 5, "long")]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    assert found_collocations(docs, min_count=least, **options) == brute_collocations(rows, least)


def test_collocations_top_ties_and_absorbed(spark):
    rows = [(k, "b a, d c, f e. a b c, a b x", "en") for k in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    assert found_collocations(docs, min_count=10, top=2) == brute_collocations(rows, 10, top=2)
    assert found_collocations(docs, min_count=10, absorbed=50) == brute_collocations(rows, 10, absorbed=50)
    assert found_collocations(docs, min_count=11, max_words=2) == brute_collocations(rows, 11, longest=2)


def test_collocations_of_long_and_of_no_texts(spark):
    rows = [(1, LONG, "en")]
    assert found_collocations(spark.createDataFrame(rows, DOCS)) == [("en", 1, "word other", 60_000, 60_000, 60_000, 120_000, 2000)]
    for rows in ([], [(1, None, None)], [(1, " .\t,", "en")], [(1, "rare words here", "en")]):
        assert found_collocations(spark.createDataFrame(rows, DOCS)) == []


def test_neighbours_end_at_pieces():
    block = collocations._Block()
    block.add(b"A b. a\tB ! a b")
    block.add(b"a")
    codes = np.concatenate(block.codes)
    at = np.flatnonzero(codes)
    first, left, right = collocations.neighbours(at, codes[at])
    assert [(list(block.words)[x], list(block.words)[y]) for x, y in zip(left, right)] == [(b"a", b"b")] * 3
    assert (codes[first] == 1).all()


def test_sums_of_pairs_by_part(spark):
    rng, sums = np.random.default_rng(5), Counter()
    relation, names = [], rng.integers(0, 1 << 40, 30)
    for block in range(12):
        ids = names[rng.integers(0, 30, 400)]
        sums.update(zip(ids.tolist(), ids[1:].tolist()))
        relation += collocations._relation(block, np.arange(400), ids).to_pylist()
    rows = spark.createDataFrame(relation, collocations._RELATION).repartition(2)
    for parts, held in ((1, 1 << 20), (5, 300), (7, 5000)):
        found = collocations.summed_pairs(rows, parts, 6, held_rows=held).collect()
        assert {(r["left"], r["right"]): r["f"] for r in found} == {p: n for p, n in sums.items() if n >= 6}
        assert len(found) == sum(n >= 6 for n in sums.values())


def test_blocks_that_are_given_away_leave_no_cycles():
    gc.collect()
    gc.disable()
    try:
        for _ in range(3):
            block = collocations._Block()
            block.add(b"some words of a block " * 50)
            assert block.row(0, "en").column("total")[0].as_py() == 250
        del block
        assert gc.collect() == 0  # words of former blocks would wait here
    finally:
        gc.enable()


def test_a_part_is_summed_up_slice_by_slice(monkeypatch):
    rng, parts, held = np.random.default_rng(3), 3, 1000
    pairs = pa.table([pa.array(rng.integers(0, 200, 30_000)) for _ in range(2)] + [pa.array(np.ones(30_000, np.int64))],
                     names=["left", "right", "n"])
    segments = [s for k in range(0, 30_000, 500) for s in collocations._by_part(pairs.slice(k, 500), parts)]
    one = pa.Table.from_batches([s for s in segments if s.column("part")[0].as_py() == 1])
    seen, sums = [], collocations._sums
    monkeypatch.setattr(collocations, "_sums", lambda counts: seen.append(sum(map(len, counts))) or sums(counts))
    got = [tuple(row.values()) for part in collocations.sliced_sums(one, parts, held) for row in part.to_pylist()]
    assert sum(seen) == sum(one.column("rows").to_pylist()) > 8 * held and max(seen) < 1.5 * held
    own = collocations.part_of(pairs["left"].to_numpy(), pairs["right"].to_numpy(), parts) == 1
    wanted = Counter(zip(*(pairs[c].to_numpy()[own].tolist() for c in ("left", "right"))))
    assert dict(((left, right), n) for left, right, n in got) == wanted and len(got) == len(wanted)


def test_packed_pairs_take_few_bytes():
    rng = np.random.default_rng(2)
    left, right, n = np.sort(rng.integers(0, 20_000, 50_000)), rng.integers(0, 20_000, 50_000), rng.integers(1, 4, 50_000)
    left, right = (x % 30 << 33 | x for x in (left, right))
    data = collocations.packed(np.diff(left, prepend=0), right, n)
    steps, *others = collocations.unpacked(data, 50_000, 3)
    assert np.array_equal(np.cumsum(steps), left) and np.array_equal(others, [right, n]) and len(data) < 8 * 50_000
    assert collocations.unpacked(collocations.packed(*[np.array([-1, 1 << 62])] * 3), 2, 3).tolist() == [[-1, 1 << 62]] * 3


def test_occurrences_do_not_pile_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(collocations, "work_path", lambda spark, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    docs = spark.createDataFrame([(k, "a b c d e f", "en") for k in range(10)], DOCS)
    assert found_collocations(docs, min_count=10) and not list(tmp_path.iterdir())


# --- MinHash near duplicates -----------------------------------------------------------------

def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_groups(rows, percent):
    sets = [brute_set(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i, one in enumerate(sets):
        for j in range(i):
            common = len(one & sets[j])
            if one and sets[j] and 100 * common >= percent * (len(one) + len(sets[j]) - common):
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for k, row in enumerate(rows):
        ids = [r[0] for r, x in zip(rows, label) if x == label[k] and r[0] is not None]
        out.append((row[0], len(sets[k]), min(ids, default=None)))
    return sorted(out, key=str)


def found_groups(docs, **options):
    return sorted(map(tuple, minhash.near_duplicates(docs, **options).collect()), key=str)


def near_copies(rng, words, copies, changes):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(changes + 1)):
            own[rng.randrange(words)] = f"n{rng.randrange(10_000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("options", "percent"), [({"similarity": 0.85}, 85), ({"similarity": 0.85, "block_rows": 7}, 85),
                                                  ({"send_rows": 0, "block_bytes": 20_000}, 80)])
def test_groups_equal_brute_force(spark, options, percent):
    """Groups of copies around the border: many pairs of a bucket that are no links."""
    rng = random.Random(5)
    texts = [t for words, copies, changes in ((60, 50, 2), (150, 60, 5), (400, 20, 12), (30, 30, 1), (200, 10, 0))
             for t in near_copies(rng, words, copies, changes)]
    texts += [None, "", " \t\n", "one two", "ONE  two", "two one", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    rows = [(k if k % 20 else None, t, "en") for k, t in enumerate(texts)]
    rows += [(3, "an id of two texts that differ", "en"), rows[7], (5, rows[9][1], "en")]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(4))
    assert found_groups(docs, **options) == brute_groups(rows, percent)


def test_groups_of_long_and_of_no_texts(spark):
    rows = [(4, LONG, "en"), (2, LONG.upper() + " more", "en"), (3, "word other", "en")]
    assert found_groups(spark.createDataFrame(rows, DOCS)) == brute_groups(rows, 80)
    assert found_groups(spark.createDataFrame([], DOCS)) == []
    assert found_groups(spark.createDataFrame([(2, None, None), (2, "", "en"), (None, " ", "en")], DOCS)) == [
        (2, 0, 2), (2, 0, 2), (None, 0, None)]


def test_sets_are_read_in_parts(monkeypatch):
    text = " ".join(f"W{k % 700}" for k in range(3000)).encode()
    whole = minhash.Shingles().of(text)
    monkeypatch.setattr(minhash, "slices", lambda t: __import__("topicloom.llm.common", fromlist=["x"]).slices(t, 50))
    assert np.array_equal(minhash.Shingles().of(text), whole) and len(whole) == len(brute_set(text.decode()))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.85):
        x = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
        both = int(2000 * share)
        one, two = np.unique(x[:2000]), np.unique(np.concatenate([x[:both], x[2000 : 4000 - both]]))
        true = both / (4000 - both)
        agree = (minhash.signature(one, 512) == minhash.signature(two, 512)).mean()
        assert abs(agree - true) < 5 * math.sqrt(true * (1 - true) / 512)


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)]
    pairs += [(5000, 5001 + k) for k in range(50)] + [(7, 7)]
    label = {n: n for p in pairs for n in p}
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(map(tuple, minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {n: x for n, x in label.items() if any(a != b and n in (a, b) for a, b in pairs)}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- hard negatives ------------------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<double>"


def brute_negatives(rows, every=10, positives=5, count=10):
    usable = {(i, label, tuple(v)) for i, label, v in rows if i is not None and label is not None and v is not None
              and all(x is not None and math.isfinite(x) for x in v)}
    usable = sorted((i, label, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, label, v in usable)
    clip = lambda s: max(min(s, 2**63 - 1), -(2**63))
    out = []
    for own, label, v in usable:
        if own % every:
            continue
        scored = [(-clip(sum(x * y for x, y in zip(v, w))), i, other) for i, other, w in usable if i != own]
        for score, positive, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fits = sorted(s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score)
            out += [(own, positive, rank, i, -score, -s) for rank, (s, i, _) in enumerate(fits[:count], 1)]
    return sorted(out)


def found_negatives(frame, **options):
    rows = negatives.hard_negatives(frame, F.col("id") % 10 == 0, **options)
    return sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("options", [{}, {"row_bytes": 600, "anchor_bytes": 300}])
def test_negatives_equal_brute_force(spark, options):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 8))
    x[40:80] = x[40]
    rows = [(k, int(rng.integers(0, 4)), v.tolist()) for k, v in enumerate(x)]
    rows += [rows[20], rows[20], (30, 2, x[3].tolist()), (None, 1, x[0].tolist()), (201, None, x[0].tolist()), (202, 1, None),
             (203, 1, [1.0, None]), (204, 1, [math.nan] * 8), (205, 1, [math.inf] * 8), (210, 1, []), (211, 2, [0.5] * 12),
             (-10, 1, [0.0] * 8), (213, 3, [0.25] * 3)]
    frame = clashing(spark.createDataFrame(rows, VECTORS))
    assert found_negatives(frame, **options) == brute_negatives(rows)


@pytest.mark.parametrize("size", [1e3, 1e8, 1e12, 1e25, 1e307])
def test_scores_are_exact_at_any_size(spark, size):
    rng = np.random.default_rng(3)
    rows = [(k, k % 3, (size * v).tolist()) for k, v in enumerate(rng.normal(size=(40, 5)))]
    rows += [(100 + k, k % 3, v.tolist()) for k, v in enumerate(rng.normal(size=(20, 5)))]
    assert found_negatives(spark.createDataFrame(rows, VECTORS)) == brute_negatives(rows)


def test_packed_fields_do_not_run_over():
    rng = np.random.default_rng(9)
    for most in (0, 1, 3, 200, 40_000, 10**9):
        rows, asked = rng.integers(-most, most + 1, (33, 7)), rng.integers(-most, most + 1, 7).tolist()
        rows[0], rows[1] = most, -most
        for anchor in (asked, [most] * 7, [-most] * 7):
            got = negatives.Packed(rows, most).scores(anchor)
            assert got.tolist() == [max(min(sum(int(a) * b for a, b in zip(r, anchor)), 2**63 - 1), -(2**63)) for r in rows]


def test_negatives_of_no_rows(spark):
    for rows in ([], [(10, 1, [1.0])], [(10, None, [1.0]), (20, 1, None)], [(11, 1, [1.0]), (12, 1, [1.0])]):
        assert found_negatives(spark.createDataFrame(rows, VECTORS)) == []
