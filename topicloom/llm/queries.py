"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import (
    collocations,
    extract,
    langid,
    licenses,
    minhash,
    mixing,
    neardup,
    negatives,
    neighbours,
    pieces,
    quality,
    urls,
    warc,
)
from topicloom.llm.common import saved, text_batches
from topicloom.session import work_path

DOMAINS = {"clean": 0.97, "toxic": 0.02, "junk": 0.01}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def labelled_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labels table: toxic, else junk, else clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk")
                         .when(F.col("quality") == 1, "clean").alias("domain"))


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, folder, "documents")
    stats = saved(docs.select("doc_id", quality.text_counts(F.col("text")).alias("_counts")), "counts")
    rules = quality.rules_from(stats, table(spark, folder, "labels"))
    return quality.judged(stats, rules).select(
        "doc_id", *[f"_counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "_quality.base_failed", "_quality.rule", "_quality.kept")


def op2_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict")


def op4_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    text_batches(spark)
    return warc.round_trip(table(spark, folder, "pages"), work_path(spark, "llm-warc")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(table(spark, folder, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    text_batches(spark)
    return neardup.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", neardup.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    text_batches(spark)
    return pieces.encoded(table(spark, folder, "documents"), piece_model(), digests_only=True)


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return langid.with_language(docs).select(
        "doc_id", langid.held_out().alias("held_out"), "_language.lang_pred", "_language.score")


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    text_batches(spark)
    return extract.extracted(table(spark, folder, "pages"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    stored, fit = mixing.mixed_and_fit(docs, labelled_domains(table(spark, folder, "labels")), DOMAINS, keep_text=False)
    totals = {name: F.array(*map(F.lit, of)) for name, of in (("wanted", fit.wanted), ("reached", fit.reached))}
    return stored.withColumns(totals | {"out_of_reach": F.lit(fit.out_of_reach)}).select(
        "doc_id", "n_tokens", "domain", "posterior", "rate", "wanted", "reached", "out_of_reach")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents"), similarity=0.85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", wrong.alias("label"))
    return negatives.hard_negatives(vectors, F.col("id") % 100 == 0)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_learned_partitions": op2_learned_partitions,
    "op3_url_filter": op3_url_filter,
    "op4_warc_bundles": op4_warc_bundles,
    "op5_license_scan": op5_license_scan,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_language_id": op8_language_id,
    "op9_html_extraction": op9_html_extraction,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

# The others learn, search approximately, connect groups or hash in ways that SQL lacks.
ORACLES = {
    "op4_warc_bundles": f"""
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest FROM pages),
    q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= {warc.MIN_SHARED} AND page_id <> first_id THEN 'revisit' ELSE 'response' END
        AS record_type,
      CASE WHEN payload_bytes >= {warc.MIN_SHARED} AND page_id <> first_id THEN first_id END AS refers_to
    FROM q""",
    "op5_license_scan": licenses.oracle_sql(),
    "op11_collocations": collocations.oracle_sql(),
    "op12_minhash_near_dedup": minhash.oracle_sql(85),
    "op13_hard_negatives": negatives.oracle_sql(),
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
