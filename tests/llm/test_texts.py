"""Operators over texts: quality rules, near duplicates, pieces, languages, licenses, mixing."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from topicloom.llm import langid, licenses, mixing, neardup, pieces, quality
from topicloom.llm.queries import piece_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word other " * 60_000
EDGES = [None, "", " \n\t ", "x", "Ünï cödé", "same text here now", "same text here now", LONG]


def frame(spark, texts, langs=None):
    rows = [(k, t, langs[k] if langs else "en", "s", 0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    """Columns that bear names an operator might use itself."""
    names = ["fp", "label", "rate", "part", "score", "pair", "root", "kept", "rule", "_h"]
    return docs.withColumns({n: F.lit("clash") for n in names})


# --- quality rules ---------------------------------------------------------------------

def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = (text or "").split("\n")
    repeated = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:k] for k, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", "".join(words))), repeated, len(inside)


def test_counts_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab #*é\n\t\x0b\x1c  ") for _ in range(rng.randrange(80)))
        assert quality.counts_of(text)[:5] == brute_counts(text), repr(text)


def test_counts_of_edge_texts(spark):
    rows = clashing(frame(spark, EDGES)).select("doc_id", quality.text_counts(F.col("text")).alias("c")).orderBy("doc_id").collect()
    assert [tuple(r["c"])[:5] for r in rows[:7]] == [brute_counts(t) for t in EDGES[:7]]
    assert rows[7]["c"]["n_words"] == 120_000 and rows[7]["c"]["n_repeat_words"] == 120_000


def test_rules_find_what_was_planted():
    rng = np.random.default_rng(2)
    table = {"a": rng.random(3000), "b": rng.random(3000), "noise": rng.random(3000)}
    junk = ((table["a"] > 0.8) & (table["b"] <= 0.5)) | (table["b"] > 0.95)
    rules = quality.learn(table, junk)
    hit = np.zeros(3000, bool)
    for rule in rules:
        assert "noise" not in {c.feature for c in rule}
        hit |= np.logical_and.reduce([c.mask(table) for c in rule])
    assert (hit == junk).mean() > 0.98


def test_no_rules_without_both_labels_and_none_for_noise():
    values = {"a": np.arange(60.0)}
    assert quality.learn(values, np.zeros(60, bool)) == []
    assert quality.learn(values, np.ones(60, bool)) == []
    assert quality.learn({"a": np.empty(0)}, np.empty(0, bool)) == []
    assert quality.learn({"a": np.zeros(600)}, np.arange(600) % 2 == 0) == []


def test_judged_follows_the_list_in_order(spark):
    clean = " ".join(f"w{k}" for k in range(60))
    docs = frame(spark, [clean, clean.replace(" ", "# "), "short", None, "a b c " * 30])
    stats = clashing(docs).withColumn("_counts", quality.text_counts(F.col("text")))
    rules = [(quality.Condition("symbols_per_word", True, 0.5),), (quality.Condition("word_length", True, 0.0),)]
    rows = {r["doc_id"]: r["_quality"] for r in quality.judged(stats, rules[:1]).collect()}
    assert [rows[k]["kept"] for k in range(5)] == [True, False, False, False, False]
    assert [rows[k]["base_failed"] for k in range(5)] == [False, False, True, True, True]
    assert [r["_quality"]["rule"] for r in quality.judged(stats, rules).orderBy("doc_id").collect()][:2] == [2, 1]
    labels = spark.createDataFrame([(0, 1), (0, None), (99, 0)], "doc_id long, quality int")
    assert quality.rules_from(stats, labels) == []
    assert quality.judged(stats.limit(0), []).count() == 0


# --- near duplicates ----------------------------------------------------------------------

def brute_groups(prints):
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 2 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


def test_fingerprint_by_definition():
    import xxhash

    for text in ("", None, "one", "One TWO", "a b c", "a b c d e a b c É", "x " * 40):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert neardup.fingerprint_of(text) & (2**64 - 1) == bits


def test_spark_xxhash_is_the_same_hash(spark):
    import xxhash

    found = spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0]
    assert found & (2**64 - 1) == xxhash.xxh64_intdigest("a b é".encode(), 42)


@pytest.mark.parametrize("leaf_rows", [3, 40, 10_000])
def test_trie_join_finds_all_groups(spark, leaf_rows):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(120)]
    for _ in range(160):  # chains and thick groups, also across the upper bits
        prints.append(rng.choice(prints) ^ (1 << rng.randrange(64)) ^ (1 << rng.choice([0, 61, 62, 63])))
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    labels = {r["fp"]: r["label"] for r in neardup.merged_groups(
        neardup.linked_prints(df, leaf_rows=leaf_rows)).collect()}
    want = brute_groups(prints)
    sizes = {g: want.count(g) for g in want}
    assert set(labels) == {p for p, g in zip(signed, want) if sizes[g] > 1}
    for a, p in enumerate(signed):
        for b, q in enumerate(signed):
            if p in labels and q in labels:
                assert (labels[p] == labels[q]) == (want[a] == want[b])


def test_node_pairs_cover_all_links():
    rng = random.Random(1)
    leaves = [(2, 0), (3, 2), (4, 6), (4, 7), (1, 1)]
    pairs = {frozenset(p) for p in neardup.node_pairs(leaves, 2)}
    assert len(pairs) == len(neardup.node_pairs(leaves, 2))

    def leaf(p):
        return next(k for k, (d, prefix) in enumerate(leaves) if p >> (64 - d) == prefix)

    for _ in range(500):
        p = rng.getrandbits(64)
        q = p ^ (1 << rng.choice([63, 62, 61, 60, 5])) ^ (1 << rng.choice([63, 62, 61, 60, 5]))
        assert frozenset((leaf(p), leaf(q))) in pairs


def test_near_duplicates_of_edge_rows(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(EDGES)] + [(5, EDGES[5], "en", "s", 0), (None, EDGES[5], "en", "s", 0),
                                                                  (None, "nothing like it", "en", "s", 0)]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    found = neardup.near_duplicates(docs)
    got = sorted((str(r[0]), str(r[2])) for r in found.collect())
    assert got == sorted([("0", "0"), ("1", "0"), ("2", "0"), ("3", "3"), ("4", "4"), ("5", "5"), ("5", "5"), ("6", "5"),
                          ("7", "7"), ("None", "5"), ("None", "None")])
    kept = [r["doc_id"] for r in neardup.one_of_each(docs).collect()]
    assert sorted(map(str, kept)) == ["0", "3", "4", "5", "7", "None"]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


# --- pieces -----------------------------------------------------------------------------------

def test_ids_equal_the_library(spark):
    rng = random.Random(8)
    texts = EDGES + ["".join(rng.choice("ab c  ▁\n\té☃𝔘　.the in\x00") for _ in range(rng.randrange(120)))
                     for _ in range(300)] + ["ab" * 3000, " lead", "trail ", "a  b", "▁", "  "]
    docs = clashing(frame(spark, texts))
    model = pieces.loaded(piece_model())
    rows = pieces.encoded(docs, piece_model(), check_every=1).orderBy("doc_id").collect()
    assert all(r["agrees"] for r in rows)
    for text, row in zip(texts, rows, strict=True):
        ids = model.library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids and row["n_tokens"] == len(ids)
        assert row["decoded"] == model.library.decode(ids)
    short = pieces.encoded(docs, piece_model(), digests_only=True)
    assert short.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
    assert pieces.encoded(docs.limit(0), piece_model()).count() == 0


def test_every_text_is_compared_with_the_library(spark):
    texts = EDGES + ["plain words", "two  blanks", " lead", "▁ mark", "é☃", "ab" * 3000, None] * 20
    rows = pieces.encoded(frame(spark, texts), piece_model(), digests_only=True).collect()
    assert len(rows) == len(texts) and all(r["agrees"] is True for r in rows)


def test_the_pipeline_compares_every_text(spark):
    import corpus_pipeline

    rows = corpus_pipeline.sentencepiece(spark, frame(spark, ["plain words", " two  blanks", "é☃", None] * 30), "").collect()
    assert len(rows) == 120 and all(r["agrees"] is True for r in rows)


def test_a_wrong_chunk_is_found_in_any_text():
    model = pieces.Pieces(piece_model())
    wrong = {"zebra", "zebra" * 30}
    model.cache = pieces._Cache(lambda chunk: model.unknown if chunk in wrong else model.chunk_ids(chunk))
    texts = ["a b", "the zebra runs", "c", f"a {'zebra' * 30}", "  zebra", "d e"]
    for _ in range(2):  # the second time from the cache
        assert model.checked(texts, 64)[2] == [True, False, True, False, True, True]
    model.chunks = lambda text: ["zoo"]
    assert model.checked(["a", "b c", "zoo"], 64)[2] == [False, False, True]


def test_the_library_is_given_every_text_whole(tmp_path):
    (tmp_path / "rules.tsv").write_text("62 20 61\t63\n")  # "b a" is read as "c", which no chunk shows
    (tmp_path / "texts").write_text("ab ab ba ba cab xc\nx a b c abc\n" * 50)
    sentencepiece.SentencePieceTrainer.train(
        input=str(tmp_path / "texts"), model_prefix=str(tmp_path / "m"), vocab_size=20, model_type="bpe", minloglevel=2,
        normalization_rule_tsv=str(tmp_path / "rules.tsv"), remove_extra_whitespaces=False, hard_vocab_limit=False)
    model = pieces.Pieces(str(tmp_path / "m.model"))
    for every in (1, 2, 64):
        assert model.checked(["ab x", "ab ax", None, "a c"] * 3, every)[2] == [True, False, True, True] * 3


def test_both_agendas_merge_alike():
    model, rng = pieces.loaded(piece_model()), random.Random(5)
    for _ in range(300):
        chunk = "".join(rng.choice("theinaor▁") for _ in range(rng.randrange(1, 40)))
        assert model.merged(chunk) == model.merged_long(list(chunk))


def test_short_chunks_are_encoded_side_by_side(monkeypatch):
    model, rng = pieces.Pieces(piece_model()), random.Random(6)
    chunks = list({"".join(rng.choice("theinaor▁\n.,%\x00é☃𝔘的是") for _ in range(rng.randrange(pieces.SHORT)))
                   for _ in range(2000)})
    assert model.cache.encode_all(chunks) == list(map(model.chunk_ids, chunks)) and model.cache.encode_all([]) == []
    monkeypatch.setattr(model.cache, "encode", None)  # one by one is for longer ones only
    texts = [" ".join(rng.choices(chunks, k=5)) for _ in range(50)]
    texts = [text for text in texts if max(map(len, model.chunks(text)), default=0) < pieces.SHORT]
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 100)
    assert len(texts) > 10 and all(model.checked(texts, 7)[2]) and len(model.cache) <= 100


# --- languages ----------------------------------------------------------------------------

STEMS = {"aa": "bola kude mira tonu", "bb": "strex flanz grumb wrelt", "cc": "ñandé çoué éàri ôlum"}


def invented(count, seed=0):
    rng, texts, langs = random.Random(seed), [], []
    for k in range(count):
        lang = sorted(STEMS)[k % 3]
        texts.append(" ".join(rng.choice(STEMS[lang].split()) + rng.choice("aeiou") for _ in range(rng.randint(4, 120))))
        langs.append(lang)
    return texts, langs


def test_held_out_languages(spark):
    texts, langs = invented(400)
    docs = clashing(frame(spark, [*texts, None, "123 !!", ""], [*langs, "aa", None, "bb"]))
    rows = langid.with_language(docs).select("doc_id", langid.held_out().alias("out"), "_language.*", "lang").collect()
    for r in rows:
        assert r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    judged = [r for r in rows if r["doc_id"] < 400 and r["out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in judged) > 0.97 * len(judged)
    assert {r["lang_pred"] for r in rows if r["doc_id"] >= 400} == {"und"}


def test_nothing_to_learn_from(spark):
    docs = frame(spark, ["some text"], [None])
    assert langid.with_language(docs).first()["_language"]["lang_pred"] == "und"
    assert langid.with_language(docs.limit(0)).count() == 0


def test_tables_equal_convolution():
    texts, langs = invented(60)
    net = langid.train(texts, langs, steps=30)
    x = np.random.default_rng(0).integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    e, top = net.embedding[x], []
    for w in net.filters:
        places = langid.WINDOW - len(w) + 1
        top.append(sum(e[:, j : j + places] @ w[j] for j in range(len(w))).max(1))
    logits = np.maximum(np.hstack(top) + net.bias, 0) @ net.out + net.out_bias
    want = logits - np.log(np.exp(logits - logits.max(1, keepdims=True)).sum(1, keepdims=True)) - logits.max(1, keepdims=True)
    assert np.allclose(langid.Scorer(net).windows(x), want, atol=1e-3)


# --- licenses ---------------------------------------------------------------------------------

def brute_licenses(texts):
    def shingles(text):
        w = [x for x in re.split(r"[^\w]|_", (text or "").lower()) if x]
        return [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]

    out = set()
    for name, template in licenses.TEMPLATES.items():
        want = set(shingles(template))
        for k, text in enumerate(texts):
            have = shingles(text)
            for at in range(len(have)):
                if want & set(have[at : at + 2]):
                    near = have[max(0, at - len(want)) : at + len(want) + 2]
                    if len(want & set(near)) / len(want) >= 0.8:
                        out.add((k, name))
    return out


def test_licenses_equal_brute_force(spark):
    rng = random.Random(3)
    statements = list(licenses.TEMPLATES.values())
    texts = list(EDGES)
    for _ in range(120):
        words = [rng.choice("the of under license version and a work".split()) for _ in range(rng.randrange(40))]
        copy = rng.choice(statements).split()
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            copy[rng.randrange(len(copy))] = "other"
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + copy + words[at:]))
    docs = clashing(frame(spark, texts))
    got = {(r["doc_id"], r["license"]) for r in licenses.scanned(docs).collect()}
    assert got == brute_licenses(texts)
    assert licenses.scanned(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scanned(docs, {"short": "too few words"})


def test_license_scan_is_native(spark):
    plan = licenses.scanned(frame(spark, EDGES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- mixing -------------------------------------------------------------------------------------

def test_rates_reach_targets_as_numpy_finds_them(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    tokens = rng.integers(1, 500, 300)
    rows = [(int(t), *map(float, q)) for t, q in zip(tokens, p)]
    stored = spark.createDataFrame(rows, "_tokens long, _p0 double, _p1 double, _p2 double")
    fit = mixing.fit_rates(stored, [0.6, 0.3, 0.1], max_rounds=60, tolerance=1e-6)
    assert np.allclose(fit.reached, fit.wanted, rtol=1e-4)
    rates = np.array([r[0] for r in stored.select(fit.rate).collect()])
    assert (rates >= 0).all()
    assert np.allclose(tokens * rates @ p, fit.wanted, rtol=1e-4)
    rate, metric = np.ones(300), np.linalg.pinv((p * tokens[:, None]).T @ p)
    for _ in range(fit.rounds):
        rate = np.maximum(0, rate - p @ metric @ ((tokens * rate) @ p - fit.wanted))
    assert np.allclose(rate, rates, atol=1e-6)


def test_mixing_of_edge_rows(spark):
    texts = EDGES + [f"nice words number{k} here" for k in range(60)] + [f"vile trash number{k} # here" for k in range(60)]
    docs = clashing(frame(spark, texts))
    known = spark.createDataFrame([(k, "good" if k < 68 else "bad") for k in range(8, 128)] + [(999, "bad"), (5, None)],
                                  "doc_id long, domain string")
    out = mixing.mixed(docs, known, {"good": 0.9, "bad": 0.1})
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == len(texts) and rows[0]["n_tokens"] == 0 and rows[7]["n_tokens"] == 120_000
    assert all(rows[k]["domain"] == ("good" if k < 68 else "bad") for k in range(8, 128))
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 and r["rate"] >= 0 for r in rows.values())
    mass = [sum(r["rate"] * r["n_tokens"] * r["posterior"][k] for r in rows.values()) for k in (0, 1)]
    assert mass[1] / sum(mass) == pytest.approx(0.1, abs=0.005)
    alone = mixing.mixed(docs, known.limit(0), {"good": 0.9, "bad": 0.1}).first()
    assert alone["posterior"] == [0.5, 0.5]
    assert mixing.mixed(docs.limit(0), known, {"good": 0.9, "bad": 0.1}).count() == 0


def labelled_texts(good, bad):
    texts = [f"nice words number{k} here" for k in range(good)] + [f"vile trash number{k} # here" for k in range(bad)]
    return texts, [(k, "good" if k < good else "bad") for k in range(good + bad)]


def test_domains_without_labels_take_no_part(spark):
    texts, known = labelled_texts(190, 10)
    docs, known = frame(spark, texts), spark.createDataFrame(known, "doc_id long, domain string")
    rows = mixing.mixed(docs, known, {"good": 0.9, "bad": 0.05, "ugly": 0.05}).collect()
    assert all(r["posterior"][2] == 0 and abs(sum(r["posterior"]) - 1) < 1e-9 for r in rows)
    mass = [sum(r["rate"] * r["n_tokens"] * r["posterior"][k] for r in rows) for k in range(3)]
    assert sum(mass) == pytest.approx(sum(r["n_tokens"] for r in rows), rel=0.01)
    assert mass[1] / sum(mass) == pytest.approx(0.05 / 0.95, abs=0.002)


def test_posteriors_equal_a_naive_bayes_by_hand(spark):
    rng = random.Random(4)
    common = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choices(common, k=12) + rng.choices(own, k=3)) + end
             for own, end in (([f"good{k}" for k in range(6)], "!"), ([f"bad{k}" for k in range(6)], " #")) for _ in range(120)]
    known = {k: int(k >= 120) for k in range(0, 240, 2)}
    docs = frame(spark, texts)
    labelled = spark.createDataFrame([(k, "bad" if y else "good") for k, y in known.items()], "doc_id long, domain string")
    traits = [set(re.findall(r"[a-z0-9]+|[!#]", t)) for t in texts]
    every = sorted(set().union(*traits))
    bucket = spark.createDataFrame([(w,) for w in every], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)))
    bucket = dict(map(tuple, bucket.collect()))
    inside = np.zeros((240, mixing.BUCKETS))
    for k, mine in enumerate(traits):
        inside[k, [bucket[w] for w in mine]] = 1
    label = np.array([known.get(k, -1) for k in range(240)])
    n = np.array([(label == y).sum() for y in (0, 1)])
    have = np.array([inside[label == y].sum(0) for y in (0, 1)])
    chance = (have + 0.5) / (n[:, None] + 1)
    expected = have.sum(0) * n[:, None] / n.sum()
    tells = ((have - expected > 5 * np.sqrt(expected + 1)) & (chance > 2 * (have[::-1] / n[::-1, None]))).any(0)
    assert 2 <= tells.sum() < len(every) / 2
    score = [np.log((n[y] + 1) / (n.sum() + 2)) + (np.log(np.where(inside > 0, chance[y], 1 - chance[y])) * tells).sum(1) for y in (0, 1)]
    want = 1 / (1 + np.exp(np.clip(score[1] - score[0], -30, 30)))
    got = mixing.with_posteriors(docs, labelled, ["good", "bad"]).orderBy("doc_id").select("_p0").collect()
    assert np.allclose([r[0] for r in got], want, atol=1e-3)


def test_samples_are_sorted_from_a_bounded_number_of_rows(spark):
    from topicloom.llm.common import by_hash

    assert by_hash(spark.range(900), 500, "id").count() == 900
    for rows in (20_000, 200_000):
        assert 600 < by_hash(spark.range(rows), 500, "id").count() < 900
    assert by_hash(spark.range(0), 500, "id").count() == 0


@pytest.mark.parametrize("bad", [1, 60])
def test_scarce_domains_do_not_shrink_the_mix(spark, bad):
    p = [(10, 1.0, 0.0, 0.0)] * 600 + [(10, 0.0, 1.0, 0.0)] * bad
    stored = spark.createDataFrame(p, "_tokens long, _p0 double, _p1 double, _p2 double")
    fit = mixing.fit_rates(stored, [0.8, 0.1, 0.1])
    assert fit.wanted == pytest.approx([(600 + bad) * 80 / 9, (600 + bad) * 10 / 9, 0.0])
    assert fit.reached == pytest.approx(fit.wanted, rel=2e-3)


@pytest.mark.parametrize("missing", ["toxic", "junk"])
def test_pipeline_mixes_without_labels_of_a_domain(spark, tmp_path, missing):
    import corpus_pipeline

    texts, known = labelled_texts(190, 10)
    flags = {"junk": (0, 1), "toxic": (0, 0)}[missing]  # what the bad ones are labelled: toxic or junk
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 1, 0) if domain == "good" else (k, *flags) for k, domain in known]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.mixing_to_targets(spark, docs, str(tmp_path))
    assert kept.where(F.col("doc_id") < 190).select("doc_id").distinct().count() == 190


def test_rates_reach_small_targets_far_from_the_corpus(spark):
    # Most documents have twice the wanted part of junk, few have less.
    p = [(100, 0.978, 0.002, 0.02)] * 700 + [(100, 0.992, 0.002, 0.006)] * 60 + [(100, 0.1, 0.8, 0.1)] * 120
    p += [(100, 0.05, 0.05, 0.9)] * 90 + [(0, 0.5, 0.25, 0.25)]
    stored = spark.createDataFrame(p, "_tokens long, _p0 double, _p1 double, _p2 double")
    fit = mixing.fit_rates(stored, [0.97, 0.02, 0.01])
    assert fit.converged and fit.reached == pytest.approx(fit.wanted, rel=1.1e-3)
    rates = np.array([r[0] for r in stored.select(fit.rate).collect()])
    x = np.array(p)
    assert (rates >= 0).all() and (x[:, 0] * rates) @ x[:, 1:] == pytest.approx(fit.wanted, rel=1.1e-3)


def test_targets_out_of_reach_are_missed_by_as_little_as_possible(spark):
    p = [(100, 0.96, 0.04)] * 50 + [(100, 0.8, 0.2)] * 50  # no mix has less than 4 % of the second
    stored = spark.createDataFrame(p, "_tokens long, _p0 double, _p1 double")
    fit = mixing.fit_rates(stored, [0.99, 0.01])
    x, wanted = np.array(p)[:, 1:], np.array(fit.wanted)
    metric = np.linalg.inv(100 * x.T @ x)
    ray = x[0] * (x[0] @ metric @ wanted) / (x[0] @ metric @ x[0])  # the nearest point of the edge of the cone
    far = lambda totals: (totals - wanted) @ metric @ (totals - wanted)
    assert fit.converged and fit.out_of_reach and far(np.array(fit.reached)) <= 1.02 * far(ray)
    rows = mixing.totals(spark, {"good": 0.99, "bad": 0.01}, fit).collect()
    assert [(r["domain"], r["wanted"], r["reached"], r["out_of_reach"]) for r in rows] == [
        (d, w, r, True) for d, w, r in zip(("good", "bad"), fit.wanted, fit.reached)]


def test_copies_follow_the_rate(spark):
    rows = spark.range(4000).select(mixing.copies(F.lit(1.25), F.col("id")).alias("n")).groupBy("n").count().collect()
    share = {r["n"]: r["count"] / 4000 for r in rows}
    assert set(share) == {1, 2} and abs(share[2] - 0.25) < 0.03
