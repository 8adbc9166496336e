"""Text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.operators.models import embed_texts, hashing_embedder
from topicloom.plans.runs import embed_tickets as embed_tickets_job
from topicloom.sources import tables

TABLE_DIMENSION = 64


def pii_mask(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.col("text")
    documents = tables.table(spark, folder, "documents", heavy=True)
    masked = documents.withColumn("masked", T.mask_pii(raw))
    return masked.select(
        "doc_id", F.md5("masked").alias("masked_md5"), F.length("masked").alias("masked_chars"),
        T.redaction_count(raw, F.col("masked")).alias("redactions"))


def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    clean = tables.table(spark, folder, "pages", heavy=True).select(
        "page_id", T.html_to_text(F.col("html")).alias("clean"))
    return clean.select("page_id", F.md5("clean").alias("clean_md5"),
                        F.length("clean").alias("clean_chars"))


def ticket_text(spark: SparkSession, folder: str) -> DataFrame:
    tickets = tables.ticket_texts(spark, folder)
    joined = tickets.withColumn("joined", T.ticket_text(F.col("subject"), F.col("description")))
    return joined.select(
        "ticket_id", F.md5("joined").alias("text_md5"), F.length("joined").alias("text_chars"),
        T.is_blank(F.col("joined")).alias("is_blank"))


def label_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as model answers: labelled, only summarized, or free text."""
    talk = F.col("text")
    answer = (
        F.when(F.col("role") == "user",
               F.concat(F.lit("Label: "), talk, F.lit("\nsummary:  "), talk))
        .when(F.col("role") == "assistant", F.concat(F.lit("SUMMARY:\n"), talk))
        .otherwise(talk)
    )
    answers = tables.table(spark, folder, "conversations").withColumn("answer", answer)
    return answers.select("conv_id", "turn", T.parse_label(F.col("answer")).alias("label"),
                          T.parse_summary(F.col("answer")).alias("summary"))


def tenant_from_url(spark: SparkSession, folder: str) -> DataFrame:
    origin = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    return tables.table(spark, folder, "pages").select(
        "page_id", T.host_key(origin, ".example.com").alias("tenant"))


def embed_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Word hashing of whole documents, one row per non-zero entry."""
    texts = tables.table(spark, folder, "documents", heavy=True).select("doc_id", "text")
    return _entries(embed_texts(texts, "text", hashing_embedder(TABLE_DIMENSION), TABLE_DIMENSION),
                    "doc_id")


def embed_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Mask and embed every ticket without a vector."""
    vectors = embed_tickets_job(
        tables.tickets(spark, folder, heavy=True), hashing_embedder(TABLE_DIMENSION), TABLE_DIMENSION)
    return _entries(vectors, "ticket_id")


def _entries(vectors: DataFrame, id_col: str) -> DataFrame:
    entries = vectors.select(id_col, F.posexplode("embedding").alias("position", "value"))
    return entries.filter(F.col("value") != 0).select(
        id_col, "position", F.round(F.col("value").cast("double"), 5).alias("value"))


QUERIES = {
    "pii_mask": pii_mask,
    "html_to_text": html_to_text,
    "ticket_text": ticket_text,
    "label_parse": label_parse,
    "tenant_from_url": tenant_from_url,
    "embed_hash": embed_hash,
    "embed_tickets": embed_tickets,
}

# SQL texts -----------------------------------------------------------------

SQL_TICKETS = r"""
SELECT source AS account_id, lang AS run_id, doc_id AS ticket_id,
       split_part(text, chr(10), 1) AS subject,
       CASE WHEN instr(text, chr(10)) > 0
            THEN substr(text, instr(text, chr(10)) + 1) END AS description
FROM documents"""


def sql_masked(column: str) -> str:
    """The three passes with plain patterns; the engine has no lookaround."""
    return rf"""regexp_replace(regexp_replace(regexp_replace({column},
        '[\w.+-]+@[\w-]+\.[\w.-]+', '[REDACTED]', 'g'),
        '\b\+?\d[\d\s().-]{{7,}}\d\b', '[REDACTED]', 'g'),
        '\b(?:\d[ -]*?){{13,19}}\b', '[REDACTED]', 'g')"""


def sql_hashed(source: str, id_col: str) -> str:
    """Signed word counts of ``source(id, text)``, scaled to unit length."""
    return rf"""
words AS (SELECT {id_col}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM {source}),
codes AS (SELECT {id_col}, CAST('0x' || substr(md5(word), 1, 8) AS UBIGINT) AS code FROM words),
slots AS (SELECT {id_col}, CAST(code % 64 AS INTEGER) AS position,
                 SUM(CASE WHEN code < 2147483648 THEN 1 ELSE -1 END) AS value
          FROM codes GROUP BY 1, 2),
norms AS (SELECT {id_col}, sqrt(SUM(value * value)) AS length FROM slots GROUP BY 1)
SELECT {id_col}, position,
       round(CAST(CAST(value / length AS FLOAT) AS DOUBLE), 5) AS value
FROM slots JOIN norms USING ({id_col}) WHERE value <> 0"""


ORACLES = {
    "pii_mask": f"""
WITH passes AS (
  SELECT doc_id, text AS t0,
         regexp_replace(text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+', '[REDACTED]', 'g') AS t1
  FROM documents),
phones AS (SELECT *, regexp_replace(t1, '\\b\\+?\\d[\\d\\s().-]{{7,}}\\d\\b', '[REDACTED]', 'g') AS t2 FROM passes),
cards AS (SELECT *, regexp_replace(t2, '\\b(?:\\d[ -]*?){{13,19}}\\b', '[REDACTED]', 'g') AS t3 FROM phones)
SELECT doc_id, md5(t3) AS masked_md5, CAST(length(t3) AS INTEGER) AS masked_chars,
       CAST(len(regexp_extract_all(t0, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+'))
          + len(regexp_extract_all(t1, '\\b\\+?\\d[\\d\\s().-]{{7,}}\\d\\b'))
          + len(regexp_extract_all(t2, '\\b(?:\\d[ -]*?){{13,19}}\\b')) AS INTEGER) AS redactions
FROM cards""",
    # e000-range characters mark breaks (1, 2, 3), forced breaks (4), heading
    # bounds (5, 6) and list items (7); the pages have no numbered list.
    "html_to_text": r"""
WITH visible AS (
  SELECT page_id, regexp_replace(regexp_replace(html,
    '(?is)<!--.*?-->|<script(?:[\s/][^>]*)?>.*?</script\s*>|<style(?:[\s/][^>]*)?>.*?</style\s*>|<head(?:[\s/][^>]*)?>.*?</head\s*>',
    '', 'g'), '[ \t\r\n\f]+', ' ', 'g') AS h FROM pages),
blocks AS (
  SELECT page_id,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,
      '(?i)<h[1-3](?:[\s/][^>]*)?>', chr(57347) || chr(57349), 'g'),
      '(?i)</h[1-6](?:[\s/][^>]*)?>', chr(57350) || chr(57346), 'g'),
      '(?i)<br(?:[\s/][^>]*)?>', chr(57348), 'g'),
      '(?i)<li(?:[\s/][^>]*)?>', chr(57345) || chr(57351), 'g'),
      '(?i)</?(?:p|ul)(?:[\s/][^>]*)?>', chr(57346), 'g'),
      '(?i)</?(?:li|article|div|footer|nav)(?:[\s/][^>]*)?>', chr(57345), 'g') AS h
  FROM visible),
bare AS (
  SELECT page_id, regexp_replace(regexp_replace(h,
    '</?[a-zA-Z][^>]*>|<[!?][^>]*>', '', 'g'), ' {2,}', ' ', 'g') AS h FROM blocks),
decoded AS (
  SELECT page_id, replace(replace(replace(replace(replace(replace(replace(h,
    '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
    '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&') AS h FROM bare),
headed AS (
  SELECT page_id, array_to_string(list_transform(string_split(h, chr(57349)), lambda part, i:
    CASE WHEN i = 1 THEN part
         ELSE upper(replace(split_part(part, chr(57350), 1), 'ß', 'SS'))
              || substr(part, length(split_part(part, chr(57350), 1)) + 2) END), '') AS h
  FROM decoded),
forced AS (SELECT page_id, regexp_replace(h, ' *' || chr(57348) || ' *', chr(57348), 'g') AS h FROM headed),
broken AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h,
    '[ \x{E001}\x{E002}\x{E003}]*\x{E003}[ \x{E001}\x{E002}\x{E003}]*', chr(10) || chr(10) || chr(10), 'g'),
    '[ \x{E001}\x{E002}]*\x{E002}[ \x{E001}\x{E002}]*', chr(10) || chr(10), 'g'),
    '[ \x{E001}]*\x{E001}[ \x{E001}]*', chr(10), 'g') AS h FROM forced),
final AS (
  SELECT page_id, regexp_replace(replace(regexp_replace(h, '\x{E007} ?', ' * ', 'g'), chr(57348), chr(10)),
    '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS clean FROM broken)
SELECT page_id, md5(clean) AS clean_md5, CAST(length(clean) AS INTEGER) AS clean_chars FROM final""",
    "ticket_text": f"""
WITH t AS ({SQL_TICKETS}),
j AS (SELECT ticket_id, concat_ws(chr(10) || chr(10), nullif(subject, ''), nullif(description, '')) AS joined FROM t)
SELECT ticket_id, md5(joined) AS text_md5, CAST(length(joined) AS INTEGER) AS text_chars,
       NOT regexp_matches(joined, '[^\\s\\x{{00A0}}]') AS is_blank
FROM j""",
    "label_parse": r"""
WITH a AS (
  SELECT conv_id, turn, CASE role
    WHEN 'user' THEN 'Label: ' || text || chr(10) || 'summary:  ' || text
    WHEN 'assistant' THEN 'SUMMARY:' || chr(10) || text ELSE text END AS answer
  FROM conversations)
SELECT conv_id, turn,
  CASE WHEN regexp_matches(answer, '(?i)Label:\s*(.+)')
       THEN trim(regexp_extract(answer, '(?i)Label:\s*(.+)', 1)) ELSE 'Unlabeled topic' END AS label,
  CASE WHEN regexp_matches(answer, '(?i)Summary:\s*(.+)')
       THEN trim(regexp_extract(answer, '(?i)Summary:\s*(.+)', 1)) ELSE '' END AS summary
FROM a""",
    "tenant_from_url": r"""
SELECT page_id, regexp_replace(regexp_replace(
         regexp_extract(url, '^(https?://[^/]+)', 1), '^https?://', ''),
         '\.example\.com$', '') AS tenant
FROM pages""",
    "embed_hash": "WITH " + sql_hashed("documents", "doc_id").lstrip(),
    "embed_tickets": f"""
WITH t AS ({SQL_TICKETS}),
todo AS (
  SELECT ticket_id, concat_ws(chr(10) || chr(10), nullif(subject, ''), nullif(description, '')) AS raw
  FROM t ANTI JOIN embeddings ON ticket_id = vec_id),
masked AS (SELECT ticket_id, {sql_masked("raw")} AS text FROM todo
           WHERE regexp_matches(raw, '[^\\s\\x{{00A0}}]')),"""
    + sql_hashed("masked", "ticket_id"),
}
