"""Stages of the pipeline on documents with repeated and null ids and clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from topicloom.llm import extract, neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["domain", "rate", "posterior", "n_tokens", "_tokens", "_p0", "_words", "_traits", "_copy", "_counts", "_quality",
           "_language", "_print", "_stay", "_rest", "fp", "row", "id", "doc", "c0", "label", "a.b", "Mixed Case"]


def words(rng, count):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(count))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts of two languages; ids repeat, are null, or both."""
    rng = random.Random(1)
    stems = {"en": "the of and with house water tree", "fr": "le la des avec maison eau arbre"}
    rows = []
    for k in range(160):
        lang = "en" if k % 2 else "fr"
        text = " ".join(rng.choice(stems[lang].split()) + rng.choice("abcdefgh") for _ in range(80))
        rows.append((None if k % 10 == 3 else k // 3, text, lang, "s", len(text)))
    rows += [rows[5], rows[3], (None, None, "en", "s", 0), (7, "", None, "s", 0)]
    path = tmp_path_factory.mktemp("stages")
    spark.createDataFrame(rows, DOCS).write.parquet(str(path / "documents.parquet"))
    labels = [(k, k % 5 != 0, 0) for k in range(50)]
    spark.createDataFrame([(k, int(q), t) for k, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(
        str(path / "labels.parquet"))
    return str(path)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_names_of_columns_do_not_matter(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clashing = docs.withColumns({c: F.lit("mine") for c in CLASHES})
    plain, found = stage(spark, docs, folder), stage(spark, clashing, folder)
    if name == "sentencepiece":
        digests = lambda df: sorted(map(str, df.select("doc_id", "ids_sha256", "n_tokens").collect()))
        assert digests(plain) == digests(found)
        return
    assert found.columns == clashing.columns and plain.columns == docs.columns
    assert kept(plain) == kept(found)
    assert found.select(*[F.col(f"`{c}`") for c in CLASHES]).distinct().count() <= 1


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_no_documents(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, folder).count() == 0


def test_texts_of_one_id_that_differ_stay(spark):
    rng = random.Random(4)
    one, two, three = (words(rng, 60) for _ in range(3))
    rows = [(1, one), (1, two), (2, three), (2, one), (1, one), (None, two), (None, three + " end"), (None, words(rng, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    for send_rows in (100, 0):
        found = neardup.one_of_each(docs, send_rows=send_rows)
        assert found.columns == docs.columns
        texts = [t for _, t, _ in map(tuple, found.collect())]
        assert {one, two} <= set(texts) and rows[-1][1] in texts
        assert len(texts) == len(set(texts)) and (three in texts) != (three + " end" in texts and three not in texts)
    everyone = spark.createDataFrame([(1, one), (1, two), (2, three)], "doc_id long, text string")
    assert kept(neardup.one_of_each(everyone)) == sorted([(1, one), (1, two), (2, three)], key=str)


def test_documents_without_an_id_are_drawn_one_by_one(spark):
    from topicloom.llm import mixing

    rows = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    n = rows.where(mixing.copies(F.lit(0.5), F.col("doc_id"), F.col("text")) > 0).count()
    assert 850 < n < 1150


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- a --!>", "<!-- a -->", "<!---->", "<!-- <p>x</p> -- > -->"])
def test_comments_end_as_in_browsers(comment):
    found = [b.text for b in extract.leaf_blocks(f"<p>one</p>{comment}<p>two</p>")]
    assert found == ["one", "two"]
