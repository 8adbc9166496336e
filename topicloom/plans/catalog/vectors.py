"""Vector arithmetic and nearest-neighbour search over embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.operators.cells import build_index
from topicloom.operators.nearest import assign_to_centroids as assign
from topicloom.operators.nearest import nearest, recall
from topicloom.scope import published_and_embedded
from topicloom.session import work_path
from topicloom.sources import tables

ASSIGN_THRESHOLD = 0.2
CELLS, CELL_SHARE = 20, 75


def r6(value: Column) -> Column:
    """Six decimals; adding zero turns a negative zero into zero."""
    return F.round(value, 6) + F.lit(0.0)


def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector against the one with the next id."""
    e = tables.table(spark, folder, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select(
        "vec_id", r6(V.dot(F.col("a"), F.col("b"))).alias("dot"),
        r6(V.cosine_similarity(F.col("a"), F.col("b"))).alias("similarity"),
        r6(V.cosine_distance(F.col("a"), F.col("b"))).alias("distance"))


def unit_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors stretched by their label (label 0: to zero) and scaled back."""
    e = tables.table(spark, folder, "embeddings")
    stretched = F.transform(V.as_doubles(F.col("embedding")), lambda x: x * F.col("label"))
    entries = e.select("vec_id", F.posexplode(V.unit(stretched)).alias("position", "value"))
    return entries.select("vec_id", "position", r6(F.col("value")).alias("value"))


def vector_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Vector to text and back."""
    values = V.as_doubles(F.col("embedding"))
    e = tables.table(spark, folder, "embeddings").withColumn("wire", V.format_vector(values))
    back = V.parse_vector(F.col("wire"))
    total = F.aggregate(back, F.lit(0.0), lambda acc, x: acc + x)
    return e.select(
        "vec_id", F.substring("wire", 1, 1).alias("opening"), F.substring("wire", -1, 1).alias("closing"),
        F.size(back).alias("dimensions"), (back == values).alias("same"), r6(total).alias("total"))


def vector_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of neighbours divided by two: one centroid step."""
    e = tables.table(spark, folder, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    middle = V.divide(V.add(F.col("a"), F.col("b")), F.lit(2.0))
    entries = a.join(b, "vec_id").select("vec_id", F.posexplode(middle).alias("position", "value"))
    return entries.select("vec_id", "position", r6(F.col("value")).alias("value"))


def label_means(spark: SparkSession, folder: str) -> DataFrame:
    means = V.mean_by(tables.table(spark, folder, "embeddings"), ["label"], "embedding")
    entries = means.select("label", "member_count", F.posexplode("centroid").alias("position", "value"))
    return entries.select("label", "member_count", "position", r6(F.col("value")).alias("value"))


def article_knn(spark: SparkSession, folder: str) -> DataFrame:
    """Five nearest published articles of every ticket, within its tenant."""
    articles = published_and_embedded(tables.vector_articles(spark, folder))
    found = nearest(tables.vectors(spark, folder), articles, 5, ["account_id"],
                    "ticket_id", "embedding", "article_id", "embedding")
    titles = articles.select("account_id", F.col("article_id").alias("item_id"), "title")
    return found.join(titles, ["account_id", "item_id"]).select(
        "account_id", F.col("query_id").alias("ticket_id"), F.col("item_id").alias("article_id"),
        "title", r6(F.col("distance")).alias("distance"), "rank")


def article_knn_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The same search on the block grid; four labels are one tenant with most rows."""
    few = F.when(F.col("account_id") < "4", "hot").otherwise(F.col("account_id"))
    tickets = tables.vectors(spark, folder).withColumn("account_id", few)
    articles = tables.vector_articles(spark, folder).withColumn("account_id", few)
    found = nearest(tickets, articles, 5, ["account_id"], "ticket_id", "embedding", "article_id", "embedding",
                    broadcast_bytes=0)
    return found.select("account_id", F.col("query_id").alias("ticket_id"), F.col("item_id").alias("article_id"),
                        r6(F.col("distance")).alias("distance"), "rank")


def _by_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Search over a stored index to which every third article is appended later."""
    articles = published_and_embedded(tables.vector_articles(spark, folder)).select(
        "account_id", F.col("article_id").alias("item_id"), F.col("embedding").alias("item_vector"))
    late = F.col("item_id") % 3 == 0
    index = build_index(articles.filter(~late), work_path(spark, "cells"), CELLS)
    index.append(articles.filter(late), 1)
    return index.search(tables.vectors(spark, folder), 5, CELL_SHARE, "ticket_id", "embedding")


def article_knn_ivf(spark: SparkSession, folder: str) -> DataFrame:
    """Approximate search over stored cells."""
    return _by_cells(spark, folder).select(
        "account_id", F.col("query_id").alias("ticket_id"), F.col("item_id").alias("article_id"),
        r6(F.col("distance")).alias("distance"), "rank")


def article_knn_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the exact neighbours that the search over cells finds."""
    articles = published_and_embedded(tables.vector_articles(spark, folder))
    exact = nearest(tables.vectors(spark, folder), articles, 5, ["account_id"],
                    "ticket_id", "embedding", "article_id", "embedding")
    return recall(_by_cells(spark, folder), exact).select("pairs", "found", r6(F.col("recall")).alias("recall"))


def assign_to_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Most similar label mean of every vector, if similar enough."""
    rows = tables.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("ticket_id"), "embedding", "label")
    means = V.mean_by(rows, ["label"], "embedding").select(F.col("label").alias("cluster_id"), "centroid")
    rows, means = (df.withColumn("run_id", F.lit(1)) for df in (rows, means))
    placed = assign(rows, means, ASSIGN_THRESHOLD, ["run_id"])
    return placed.select("ticket_id", "cluster_id", r6(F.col("similarity")).alias("similarity"))


QUERIES = {
    "cosine_pairs": cosine_pairs,
    "unit_normalize": unit_normalize,
    "vector_roundtrip": vector_roundtrip,
    "vector_sums": vector_sums,
    "label_means": label_means,
    "article_knn": article_knn,
    "article_knn_grid": article_knn_grid,
    "article_knn_ivf": article_knn_ivf,
    "article_knn_recall": article_knn_recall,
    "assign_to_centroids": assign_to_centroids,
}

# SQL texts -----------------------------------------------------------------

_E = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"

_UNIT = "list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"

# Centres from the articles of the first batch, then all articles by cell, then the cells a ticket visits.
_CELLS = f"""
e AS (SELECT CAST(label AS VARCHAR) AS account_id, vec_id, {_UNIT.format(v="v")} AS u FROM ({_E})),
a AS (SELECT e.account_id, e.vec_id AS article_id, e.u FROM pages p JOIN e ON e.vec_id = p.page_id
      WHERE NOT contains(p.url, '#')),
f AS (SELECT * FROM a WHERE article_id % 3 <> 0),
s AS (SELECT row_number() OVER (ORDER BY md5(account_id || '|' || article_id)) - 1 AS cell, u FROM f),
b AS (SELECT f.article_id, f.u, s.cell FROM f JOIN s ON s.cell < {CELLS}
      QUALIFY row_number() OVER (PARTITION BY f.article_id
                                 ORDER BY round(list_inner_product(f.u, s.u), 9) DESC, s.cell) = 1),
bx AS (SELECT cell, unnest(u) AS x, unnest(range(len(u))) AS position FROM b),
bs AS (SELECT cell, position, sum(CAST(round(x * 4294967296) AS BIGINT)) / 4294967296.0 AS x FROM bx GROUP BY 1, 2),
bv AS (SELECT cell, list(CAST(x AS DOUBLE) ORDER BY position) AS v FROM bs GROUP BY 1),
c AS (SELECT cell, {_UNIT.format(v="v")} AS u FROM bv),
i AS (SELECT a.*, c.cell FROM a CROSS JOIN c
      QUALIFY row_number() OVER (PARTITION BY a.article_id
                                 ORDER BY round(list_inner_product(a.u, c.u), 9) DESC, c.cell) = 1),
h AS (SELECT account_id, cell, count(*) AS held FROM i GROUP BY 1, 2),
t AS (SELECT account_id, sum(held) AS held FROM h GROUP BY 1),
o AS (SELECT e.account_id, e.vec_id, e.u, h.cell, t.held AS every, coalesce(sum(h.held) OVER (
             PARTITION BY e.vec_id ORDER BY round(list_inner_product(e.u, c.u), 9) DESC, h.cell
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM e JOIN h USING (account_id) JOIN t USING (account_id) JOIN c ON c.cell = h.cell),
n AS (SELECT o.account_id, o.vec_id AS ticket_id, i.article_id, 1 - list_inner_product(o.u, i.u) AS distance
      FROM o JOIN i ON i.account_id = o.account_id AND i.cell = o.cell
      WHERE o.before < greatest(5, ceil(o.every * {CELL_SHARE} / 100))),
r AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY round(distance, 9), article_id) AS rank
      FROM n QUALIFY rank <= 5)"""

ORACLES = {
    "cosine_pairs": f"""
WITH e AS ({_E})
SELECT a.vec_id, round(list_inner_product(a.v, b.v), 6) + 0.0 AS dot,
       round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS similarity,
       round(1 - list_cosine_similarity(a.v, b.v), 6) + 0.0 AS distance
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""",
    "unit_normalize": f"""
WITH e AS ({_E}),
s AS (SELECT vec_id, list_transform(v, lambda x: x * label) AS v FROM e),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS length FROM s),
u AS (SELECT vec_id, unnest(v) AS x, length, unnest(range(len(v))) AS position FROM n)
SELECT vec_id, CAST(position AS INTEGER) AS position,
       round(CASE WHEN length = 0 THEN x ELSE x / length END, 6) + 0.0 AS value FROM u""",
    "vector_roundtrip": f"""
WITH e AS ({_E})
SELECT vec_id, '[' AS opening, ']' AS closing, CAST(len(v) AS INTEGER) AS dimensions,
       true AS same, round(list_sum(v), 6) + 0.0 AS total FROM e""",
    "vector_sums": f"""
WITH e AS ({_E}),
p AS (SELECT a.vec_id, unnest(a.v) AS x, unnest(b.v) AS y, unnest(range(len(a.v))) AS position
      FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, CAST(position AS INTEGER) AS position, round((x + y) / 2, 6) + 0.0 AS value FROM p""",
    "label_means": f"""
WITH e AS ({_E}),
p AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS position FROM e)
SELECT label, count(*) AS member_count, CAST(position AS INTEGER) AS position,
       round(avg(x), 6) + 0.0 AS value FROM p GROUP BY label, position""",
    "article_knn": f"""
WITH e AS ({_E}),
a AS (SELECT e.label, p.page_id, e.v, regexp_extract(p.html, '<h1>([^<]*)</h1>', 1) AS title
      FROM pages p JOIN e ON e.vec_id = p.page_id WHERE NOT contains(p.url, '#')),
d AS (SELECT CAST(q.label AS VARCHAR) AS account_id, q.vec_id AS ticket_id, a.page_id AS article_id,
             a.title, 1 - list_cosine_similarity(q.v, a.v) AS distance
      FROM e q JOIN a ON a.label = q.label),
r AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY round(distance, 9), article_id) AS rank FROM d)
SELECT account_id, ticket_id, article_id, title, round(distance, 6) + 0.0 AS distance,
       CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
    "article_knn_grid": f"""
WITH e AS (SELECT CASE WHEN label < 4 THEN 'hot' ELSE CAST(label AS VARCHAR) END AS account_id, vec_id, v FROM ({_E})),
d AS (SELECT q.account_id, q.vec_id AS ticket_id, p.page_id AS article_id,
             1 - list_cosine_similarity(q.v, a.v) AS distance
      FROM e q JOIN e a USING (account_id) JOIN pages p ON p.page_id = a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY round(distance, 9), article_id) AS rank FROM d)
SELECT account_id, ticket_id, article_id, round(distance, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= 5""",
    "article_knn_ivf": f"""
WITH {_CELLS}
SELECT account_id, ticket_id, article_id, round(distance, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM r""",
    "article_knn_recall": f"""
WITH {_CELLS},
x AS (SELECT e.account_id, e.vec_id AS ticket_id, a.article_id FROM e JOIN a USING (account_id)
      QUALIFY row_number() OVER (PARTITION BY e.vec_id
                                 ORDER BY round(1 - list_inner_product(e.u, a.u), 9), a.article_id) <= 5)
SELECT count(*) AS pairs, count(r.article_id) AS found, round(count(r.article_id) / count(*), 6) + 0.0 AS recall
FROM x LEFT JOIN r USING (account_id, ticket_id, article_id)""",
    "assign_to_centroids": f"""
WITH e AS ({_E}),
p AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS position FROM e),
m AS (SELECT label, position, avg(x) AS x FROM p GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY position) AS v FROM m GROUP BY 1),
d AS (SELECT e.vec_id, c.label, list_cosine_similarity(e.v, c.v) AS similarity FROM e CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(1 - similarity, 9), label) AS k FROM d)
SELECT vec_id AS ticket_id, CASE WHEN similarity >= {ASSIGN_THRESHOLD} THEN label END AS cluster_id,
       round(similarity, 6) + 0.0 AS similarity FROM r WHERE k = 1""",
}
