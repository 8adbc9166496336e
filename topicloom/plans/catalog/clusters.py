"""Leader clustering of the given vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.vectors import mean_by
from topicloom.operators.leader import DEFAULT_MIN_SIZE, leader_pass, split_by_size
from topicloom.operators.labels import representatives as first_members
from topicloom.plans.catalog.vectors import r6
from topicloom.plans.runs import CLUSTER, centroids, member_distances, run_totals
from topicloom.session import work_path
from topicloom.sources import tables
from topicloom.streaming.leader import stream_leaders, streamed_members

# Small enough that the given tables take the many-chunks path.
CHECK_CHUNK_ROWS = 200


def leader_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return tables.leaders(spark, folder).members.select("account_id", "ticket_id", "cluster_id")


def leader_clusters_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors as one large group, settled chunk by chunk."""
    one = tables.vectors(spark, folder).withColumn("account_id", F.lit("all"))
    result = leader_pass(one, tables.TABLE_THRESHOLD, chunk_rows=CHECK_CHUNK_ROWS)
    return result.members.select("ticket_id", "cluster_id")


def leader_clusters_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors arriving in three deliveries, clustered as they come."""
    vectors = tables.vectors(spark, folder)
    third = vectors.agg(F.max("ticket_id")).first()[0] // 3
    work = work_path(spark, "stream-leaders")
    for low, high in ((-1, third), (third, 2 * third), (2 * third, 3 * third + 3)):
        part = vectors.filter((F.col("ticket_id") > low) & (F.col("ticket_id") <= high))
        part.write.mode("append").parquet(f"{work}/inbox")
        stream = spark.readStream.schema(vectors.schema).parquet(f"{work}/inbox")
        stream_leaders(stream, f"{work}/out", f"{work}/offsets",
                       tables.TABLE_THRESHOLD).awaitTermination()
    return streamed_members(spark, f"{work}/out", vectors).select("account_id", "ticket_id", "cluster_id")


def clustered_split(spark: SparkSession, folder: str) -> DataFrame:
    split = split_by_size(tables.leaders(spark, folder).members, DEFAULT_MIN_SIZE)
    return split.select("account_id", "ticket_id", "cluster_id", "is_clustered")


def cluster_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of every cluster, from its members' vectors."""
    vectors = tables.vectors(spark, folder)
    members = tables.leaders(spark, folder).members
    joined = members.join(vectors.select("account_id", "ticket_id", "embedding"),
                          ["account_id", "ticket_id"])
    means = mean_by(joined, ["account_id", "cluster_id"], "embedding")
    entries = means.select("account_id", "cluster_id", "member_count",
                           F.posexplode("centroid").alias("position", "value"))
    return entries.select("account_id", "cluster_id", "member_count", "position",
                          r6(F.col("value")).alias("value"))


def cluster_members(spark: SparkSession, folder: str) -> DataFrame:
    leaders = tables.leaders(spark, folder)
    found = member_distances(leaders.members, tables.vectors(spark, folder), centroids(leaders))
    return found.select("account_id", "cluster_id", "ticket_id", r6(F.col("distance")).alias("distance"))


def representatives(spark: SparkSession, folder: str) -> DataFrame:
    leaders = tables.leaders(spark, folder)
    kept = leaders.members.join(centroids(leaders).select(*CLUSTER), CLUSTER, "left_semi")
    return first_members(kept).select("account_id", "cluster_id", "position", "ticket_id")


def clustering_summary(spark: SparkSession, folder: str) -> DataFrame:
    leaders = leader_pass(tables.vector_tickets(spark, folder), tables.TABLE_THRESHOLD)
    return run_totals(leaders).select("account_id", "clusters_created", "tickets_clustered",
                              "tickets_unclustered")


QUERIES = {
    "leader_clusters": leader_clusters,
    "leader_clusters_rounds": leader_clusters_rounds,
    "leader_clusters_stream": leader_clusters_stream,
    "clustered_split": clustered_split,
    "centroids": cluster_centroids,
    "cluster_members": cluster_members,
    "representatives": representatives,
    "clustering_summary": clustering_summary,
}

# SQL texts -----------------------------------------------------------------


def sql_leaders(group: str) -> str:
    """Common tables up to ``member(g, id, cluster_id)``: one recursion step per row."""
    return f"""
WITH RECURSIVE v AS (
  SELECT CAST({group} AS VARCHAR) AS g, vec_id AS id, CAST(embedding AS DOUBLE[]) AS x,
         row_number() OVER (PARTITION BY {group} ORDER BY vec_id) AS i FROM embeddings),
fold AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(s DOUBLE[], ids BIGINT[])[]) AS cl FROM v
  UNION ALL
  SELECT g, i, CASE
      WHEN len(sims) > 0 AND list_max(sims) >= 0.3 THEN
        list_transform(cl, lambda c, k: CASE WHEN k = list_position(sims, list_max(sims))
          THEN {{'s': list_transform(c.s, lambda y, j: y + x[j]), 'ids': list_append(c.ids, id)}} ELSE c END)
      ELSE list_append(cl, {{'s': x, 'ids': [id]}}) END AS cl
  FROM (SELECT f.g, v.i, v.id, v.x, f.cl,
               list_transform(f.cl, lambda c: list_cosine_similarity(c.s, v.x)) AS sims
        FROM fold f JOIN v ON v.g = f.g AND v.i = f.i + 1) AS step),
done AS (SELECT g, unnest(cl) AS c FROM fold
         WHERE (g, i) IN (SELECT g, max(i) FROM v GROUP BY g)),
member AS (SELECT g, unnest(c.ids) AS id, c.ids[1] AS cluster_id, len(c.ids) AS n FROM done)"""


_BY_LABEL = sql_leaders("label")

_CENTERS = """,
entry AS (SELECT m.g, m.cluster_id, unnest(v.x) AS x, unnest(range(len(v.x))) AS position
          FROM member m JOIN v USING (g, id)),
mean AS (SELECT g, cluster_id, position, avg(x) AS x, count(*) AS n FROM entry GROUP BY 1, 2, 3),
center AS (SELECT g, cluster_id, list(x ORDER BY position) AS c, max(n) AS n FROM mean GROUP BY 1, 2)"""

ORACLES = {
    "leader_clusters": _BY_LABEL + """
SELECT g AS account_id, id AS ticket_id, cluster_id FROM member""",
    "leader_clusters_rounds": sql_leaders("1") + """
SELECT id AS ticket_id, cluster_id FROM member""",
    "leader_clusters_stream": _BY_LABEL + """
SELECT g AS account_id, id AS ticket_id, cluster_id FROM member""",
    "clustered_split": _BY_LABEL + """
SELECT g AS account_id, id AS ticket_id, CASE WHEN n >= 2 THEN cluster_id END AS cluster_id,
       n >= 2 AS is_clustered FROM member""",
    "centroids": _BY_LABEL + _CENTERS + """
SELECT g AS account_id, cluster_id, n AS member_count, CAST(position AS INTEGER) AS position,
       round(x, 6) + 0.0 AS value FROM mean""",
    "cluster_members": _BY_LABEL + _CENTERS + """
SELECT m.g AS account_id, m.cluster_id, m.id AS ticket_id,
       round(1 - list_cosine_similarity(v.x, center.c), 6) + 0.0 AS distance
FROM member m JOIN v USING (g, id) JOIN center USING (g, cluster_id) WHERE m.n >= 2""",
    "representatives": _BY_LABEL + """
SELECT * FROM (SELECT g AS account_id, cluster_id,
    CAST(row_number() OVER (PARTITION BY g, cluster_id ORDER BY id) AS INTEGER) AS position,
    id AS ticket_id FROM member WHERE n >= 2) WHERE position <= 5""",
    "clustering_summary": _BY_LABEL + """
SELECT g AS account_id, count(DISTINCT cluster_id) FILTER (n >= 2) AS clusters_created,
       count(*) FILTER (n >= 2) AS tickets_clustered, count(*) FILTER (n < 2) AS tickets_unclustered
FROM member GROUP BY g""",
}
