"""Operators over pages and vectors: neighbours, url filter, WARC bundles, main text; the pipeline."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from topicloom.llm import extract, neighbours, urls, warc
from topicloom.llm import queries as llm
from topicloom.llm.common import saved

FOLDER = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"
CLASHING = ("host", "rule", "part", "rank", "bundle", "score", "text")


def clashing(df, names=CLASHING):
    return df.withColumns({n: F.lit("clash") for n in names})


# --- neighbours ----------------------------------------------------------------------------

def clustered(count, length=16, centres=24, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, length))
    return middle[rng.integers(0, centres, count)] + 0.15 * rng.normal(size=(count, length))


def brute_neighbours(ids, x, k):
    out = {}
    for q in [i for i, v in zip(ids, x) if v is not None and i % 100 == 0]:
        own = x[ids.index(q)]
        ranked = sorted((float(np.sqrt(((own - v) ** 2).sum())), i) for i, v in zip(ids, x) if v is not None and i != q)
        out[q] = ranked[:k]
    return out


def vector_frame(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


def test_recall_and_exact_scores(spark):
    x = clustered(4000)
    df = vector_frame(spark, [(k, v.tolist()) for k, v in enumerate(x)])
    got = neighbours.nearest(df, F.col("id") % 100 == 0, partition_rows=200).collect()
    want = brute_neighbours(list(range(4000)), list(x), 10)
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by_query) == set(want)
    hits = 0
    for q, rows in by_query.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        for _, i, s in rows:
            assert s == pytest.approx(np.sqrt(((x[q] - x[i]) ** 2).sum()), rel=1e-12)
        hits += len({i for _, i, _ in rows} & {i for _, i in want[q]})
    assert hits / (10 * len(want)) >= 0.9


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    df = vector_frame(spark, [(k, v.tolist()) for k, v in enumerate(clustered(900))])
    ask = lambda: sorted(map(tuple, neighbours.nearest(df, F.col("id") % 100 == 0, partition_rows=100).collect()))
    whole = ask()
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 17)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 2)
    assert ask() == whole


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [1.0, -0.1]), (8, [1.0, -0.1]), (100, [0.0, 1.0]), (200, [0.0, 0.0])]
    got = neighbours.nearest(vector_frame(spark, rows), F.col("id") % 100 == 0).collect()
    near = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100, 200)}
    assert near == {0: [1, 8, 100], 100: [1, 0, 8], 200: []}
    for empty in (vector_frame(spark, rows).limit(0), vector_frame(spark, [(0, None), (1, None)])):
        assert neighbours.nearest(empty, F.col("id") % 100 == 0).columns == ["query_id", "rank", "vec_id", "score"]


def nearest_ids(spark, rows, **sizes):
    out = {}
    for r in neighbours.nearest(vector_frame(spark, rows), F.col("id") % 100 == 0, **sizes).collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    return {q: [ids[k] for k in sorted(ids)] for q, ids in out.items()}


def test_ties_among_thousands_of_equal_vectors(spark, monkeypatch):
    one, near = [1.0, 2.0, 0.3], [1.0, 2.0, 0.31]
    rows = [(k, one) for k in range(5000)] + [(5000 + k, near) for k in range(200)]
    want = {q: [k for k in range(11) if k != q][:10] for q in range(0, 5000, 100)}
    # Different vectors that are equally far: a circle of signs around the query.
    signs = [[float(2 * (k >> b & 1) - 1) for b in range(11)] for k in range(2048)]
    far = [(k + 1, [*s, 5.0]) for k, s in enumerate(signs) if (k + 1) % 100] + [(0, [0.0] * 11 + [5.0])]
    for block_rows in (neighbours.BLOCK_ROWS, 700):
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", block_rows)
        got = nearest_ids(spark, rows, partition_rows=10_000)
        assert {q: got[q] for q in want} == want
        assert got[5100] == list(range(5000, 5010))
        assert nearest_ids(spark, far, partition_rows=10_000)[0] == list(range(1, 11))


def test_repeated_ids_do_not_crowd_out_others(spark):
    x = clustered(400, length=4)
    rows = [(k, x[k].tolist()) for k in range(400)]
    for k in range(1, 6):  # nearer to 0 than all others: copies of a row, and rows that differ
        rows += [(k, (x[0] + 1e-4 * k).tolist())] * 40 + [(k, (x[0] + 1e-4 * k + 1e-6 * j).tolist()) for j in range(40)]
    away = lambda i: min(float(np.linalg.norm(x[0] - v)) for k, v in rows if k == i)
    want = sorted(range(1, 400), key=lambda i: (away(i), i))[:10]
    assert nearest_ids(spark, rows, partition_rows=10_000)[0] == want
    assert all(len(ids) == 10 for ids in nearest_ids(spark, rows, partition_rows=20).values())


def test_partitions_are_balanced():
    x = clustered(3000)
    label = neighbours.balanced_partition(x, neighbours.neighbour_graph(x, 8), 12)
    sizes = np.bincount(label, minlength=12)
    assert sizes.min() > 0 and sizes.max() <= np.ceil(1.1 * 250) + 1


# --- url filter --------------------------------------------------------------------------------

def brute_url(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(rule, verdict) for rule, verdict in urls.RULES for name, _, rest in [rule.partition("/")]
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_rules_equal_brute_force(spark):
    tried = ["http://a.net/x", "http://EXAMPLE.net/en/1", "https://m.example.net/en/", "https://example.net/enx", "http://a.net",
             "http://a.net?q=/", "ftp://x.example.com/de/a?b#c", "http://example.com/DE/", "https://b.org/fr/é", "nothing",
             "", None, "x://y://z/net/", "http://net/", "http://anet/", "http://a.net:80/", "http://a.org#/fr/", "://",
             "http://Ä.net/\n?", "http://" + "a" * 50_000 + ".net/p"]
    df = clashing(spark.createDataFrame([(k, u, "") for k, u in enumerate(tried)], PAGES).drop("html"), ("text", "score", "h"))
    for r in urls.judged(df).collect():
        host, path, (rule, verdict) = brute_url(tried[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
        if not host and not path:
            assert r["verdict"] == "allow"
    assert urls.judged(df.limit(0)).count() == 0


def chances(addresses, model):
    weights, bias = model
    found = [urls.gram_buckets(host, slash + path) for host, slash, path in (a.partition("/") for a in addresses.split())]
    return np.array([1 / (1 + np.exp(-(weights[f].sum() / np.sqrt(len(f)) + bias))) for f in found])


def test_classifier_on_sites_that_are_not_in_its_table():
    model = urls.train(urls.labelled_urls())
    table = " ".join(u for u, _ in urls.labelled_urls())
    good = """wikipedia.org/wiki/Spain bbc.co.uk/news docs.python.org/3/library github.com/apache/spark nytimes.com/2024/world
        stackoverflow.com/questions/12 mozilla.org/en-US archive.org/details lemonde.fr/a spiegel.de/panorama nasa.gov
        who.int/health stanford.edu debian.org/doc imdb.com/title goodreads.com/book allrecipes.com weather.gov
        theguardian.com/uk apple.com/iphone"""
    bad = """mega-casinos.com/en pokerstar-bonuses.net sexcams247.com/x xxx-videos.net torrentz-search.org/q crackedkeygens.net
        secure-login-verify.net/a paypal-account-verification.com phishing-login.example.com/en/1 adservers.net
        cheap-viagra-pill.biz payday-loan-fast.com jackpots-royal.org/fr/1 pixeltracking.io spammers.info/x
        serial-downloads.net adult-videos.com/de/2"""
    assert not any(f"/{a.partition('/')[0]}/" in table for a in (good + bad).split())
    assert (chances(good, model) < urls.THRESHOLD).all() and (chances(bad, model) > urls.THRESHOLD).all()


def test_a_labelled_table_of_the_caller(spark):
    table = urls.labelled_urls(["zebra", "okapi"], ["violin", "cello"], ["one", "two"])
    pages = spark.createDataFrame([(1, "http://zebras.one/"), (2, "http://violins.two/"), (3, "http://zebras.one/")],
                                  "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judged(pages, [], table).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}


# --- WARC -----------------------------------------------------------------------------------------

def page_rows():
    big, same = "é" * 400_000, "<p>" + "same " * 40 + "</p>"
    return [(5, "http://a/", same), (3, None, same), (9, "http://b/\r\nX: y", same), (9, "http://b/", same), (1, "u", "tiny"),
            (2, "u", "tiny"), (4, "u", None), (6, "u", ""), (7, "u", big), (None, "u", same), (8, "u", "WARC/1.1\r\n\r\n" * 30)]


def test_round_trip_of_edge_rows(spark, tmp_path):
    df = clashing(spark.createDataFrame(page_rows(), PAGES))
    index = warc.write_bundles(df, str(tmp_path))
    rows = warc.read_bundles(index, str(tmp_path), with_payload=True).collect()
    assert all(r["intact"] for r in rows)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    want = Counter()
    for page_id, _, text in page_rows():
        raw = (text or "").encode()
        first = min(i for i, _, t in page_rows() if i is not None and (t or "").encode() == raw)
        other = len(raw) >= 100 and page_id is not None and page_id != first
        want[(page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other else "response",
              first if other else None)] += 1
    assert got == want
    assert {bytes(r["payload"]) for r in rows if r["page_id"] == 7} == {("é" * 400_000).encode()}
    again = warc.fetch(index, spark.createDataFrame([(7,), (1,), (9,), (77,)], "page_id long"), str(tmp_path)).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in again) == [
        (1, "response"), (7, "response"), (9, "revisit"), (9, "revisit")]


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, tmp_path):
    import io

    import zstandard
    from pyarrow import fs

    df = spark.createDataFrame([(k, "u", f"{k} " * 30_000) for k in range(40)], PAGES).coalesce(1)
    warc.write_bundles(df, str(tmp_path))
    [bundle] = (tmp_path / "bundles").iterdir()
    with fs.LocalFileSystem().open_input_file(str(bundle)) as file:
        frames = warc.frames_of(file)
    assert len(frames) > 5 and frames[-1][0] + frames[-1][1] < bundle.stat().st_size
    data = bundle.read_bytes()
    text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert len(list(warc.parsed(text))) == 40 and sum(f[2] for f in frames) == len(text)


def test_no_pages_no_bundles(spark, tmp_path):
    df = spark.createDataFrame([], PAGES)
    assert warc.round_trip(df, str(tmp_path)).count() == 0
    assert list((tmp_path / "bundles").iterdir()) == []


# --- main text ---------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def crf():
    return extract.train(extract.labelled_pages())


def test_held_out_pages(crf):
    wrong = total = 0
    for blocks, labels in extract.labelled_pages(120, seed=99):
        wrong += int((crf.decode(extract.block_features(blocks)) != np.array(labels)).sum())
        total += len(labels)
    assert wrong / total < 0.01


def test_viterbi_and_marginals_equal_enumeration(crf):
    from itertools import product

    blocks = extract.labelled_pages(1, seed=5)[0][0][:7]
    features = extract.block_features(blocks)
    scores = crf.node_scores(features)
    ways = {w: sum(scores[k, l] for k, l in enumerate(w)) + sum(crf.pairs[a, b] for a, b in zip(w, w[1:]))
            for w in product((0, 1), repeat=len(blocks))}
    assert tuple(crf.decode(features)) == max(ways, key=ways.get)
    total = np.logaddexp.reduce(list(ways.values()))
    nodes, _ = crf.marginals(scores)
    for k in range(len(blocks)):
        assert nodes[k, 1] == pytest.approx(sum(np.exp(v - total) for w, v in ways.items() if w[k]))


def test_blocks_of_broken_markup():
    texts = lambda page: [b.text for b in extract.leaf_blocks(page)]
    assert texts("<p>a<p>b &amp; c<br>d</p><ul><li>e<li>f</ul>g") == ["a", "b & c d", "e", "f", "g"]
    assert texts("<script>if (a<b) '</p>'</script><p>x<!-- <p>no --> y</p><style>p{}</style>") == ["x y"]
    assert texts("<p title='a > b'>q &am") == ["q &am"] and texts("<p>cut <a hre") == ["cut"]
    assert texts("a < b and 1<2") == ["a < b and 1<2"] and texts(None) == texts("") == texts("  <p> </p>") == []
    assert texts("<p>x\u00a0&nbsp;\n y</p>") == ["x y"] and texts("<script>never ends") == []
    assert len(texts("<p>x" * 20_000)) == 20_000


def test_stray_quotes_in_tags_hide_no_text():
    texts = lambda page: [b.text for b in extract.leaf_blocks(page)]
    assert texts('<p class=lead">First paragraph.</p><p>Second.</p>') == ["First paragraph.", "Second."]
    assert texts("<a title=Bob's href=/x>link</a><p>Text it's.</p>") == ["link", "Text it's."]
    assert texts('<p class="a"">One</p><p>Two</p>') == ["One", "Two"]
    assert texts("<p \"x y'>One</p><p id = 'a > b' title=\"c > d\">Two</p>") == ["One", "Two"]
    assert texts("<p title=>One</p><p =\"a>Two</p><p class='open>Three</p>") == ["One", "Two"]
    [block] = extract.leaf_blocks("<a href=/x/>link</a>")
    assert block.links == 4
    assert [b.path for b in extract.leaf_blocks("<div /><p>One</p>")] == [(("p", ""),)]
    assert texts("<p " + "a=b\"c 'd " * 100_000 + ">One</p>") == ["One"]


def test_a_page_of_each_kind(spark, crf):
    page = ("<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
            "<article><h1>Title</h1><p>First <b>bold</b>\n line.</p><div class='ad'>Buy now!</div><p>Second &eacute;.</p>"
            "</article><div class='comments'><p>Nice post.</p></div><aside><p>More.</p></aside><footer>&copy; me</footer>")
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (3, "u", "")], PAGES).withColumn("text", F.lit("c"))
    rows = sorted(map(tuple, extract.extracted(df, crf=crf).collect()), key=str)
    want = "Title\n\nFirst bold line.\n\nSecond é."
    assert rows == [(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (3, "u", "", 0)]
    assert extract.extracted(df.limit(0), crf=crf).count() == 0


# --- registered queries and the pipeline -------------------------------------------------------------

needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_its_sql(spark, name):
    from tools.check_oracles import database, rows_of

    con = database(FOLDER)
    df = llm.queries()[name](spark, FOLDER)
    result = con.execute(llm.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


@needs_tables
def test_stages_hold_what_they_say(spark):
    docs = llm.table(spark, FOLDER, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, FOLDER), name)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert after.columns == columns
        if name == "simhash_near_dedup":
            before = {r["doc_id"]: r["component_id"] for r in llm.neardup.near_duplicates(docs).collect()}
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(before.values()))
        if name == "quality_rules":
            assert {r["doc_id"] for r in after.collect()} < {r["doc_id"] for r in docs.collect()}
        if name == "sentencepiece":
            assert after.count() == docs.count() and after.where("not agrees").count() == 0
        docs = after
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] and sizes[-1] > 0
    assert corpus_pipeline.run(spark, FOLDER).columns == docs.columns
