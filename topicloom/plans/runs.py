"""The three jobs: ticket embedding, article refresh, clustering of runs."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.text import is_blank, mask_pii, ticket_text
from topicloom.functions.vectors import cosine_distance
from topicloom.operators.labels import (
    REPRESENTATIVES,
    excerpts,
    extractive_labels,
    label_by_model,
    representatives,
    term_scores,
)
from topicloom.operators.leader import (
    DEFAULT_MIN_SIZE,
    DEFAULT_THRESHOLD,
    LeaderPass,
    cluster_sizes,
    leader_pass,
)
from topicloom.operators.ledger import failure_audit
from topicloom.operators.models import EMBEDDING_DIMENSION, Embed, Generate, embed_texts
from topicloom.operators.refresh import EMBEDDED, merge_articles, route_articles
from topicloom.operators.sizes import broadcast_if_small
from topicloom.operators.upsert import upsert
from topicloom.scope import needing_embedding
from topicloom.session import work_path

RUN = ["account_id", "run_id"]
CLUSTER = [*RUN, "cluster_id"]


# Names of the stored tables.
MEMBERS, CLUSTERS, AUDIT, COMMITS = "ticket_cluster_members", "ticket_clusters", "audit_logs", "commits"


def masked_ticket_text(tickets: DataFrame) -> DataFrame:
    """Masked text of the tickets that have any: what a model may see."""
    text = ticket_text(F.col("subject"), F.col("description"))
    return (tickets.withColumn("text", text).filter(~is_blank(F.col("text")))
            .withColumn("text", mask_pii(F.col("text"))))


def embed_tickets(tickets: DataFrame, build: Callable[[], Embed],
                  dimension: int = EMBEDDING_DIMENSION) -> DataFrame:
    """Vectors of the tickets that still need one."""
    todo = masked_ticket_text(needing_embedding(tickets))
    return embed_texts(todo.select("account_id", "ticket_id", "text"), "text", build, dimension)


def embed_counts(tickets: DataFrame) -> DataFrame:
    """Per run: how many tickets the embedding job takes and how many it skips."""
    todo = needing_embedding(tickets)
    blank = is_blank(ticket_text(F.col("subject"), F.col("description")))
    return todo.groupBy(*RUN).agg(
        F.count_if(~blank).alias("embedded"), F.count_if(blank).alias("skipped"))


def with_new_vectors(tickets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Stored tickets with their vectors; a table that never had any gets the column."""
    if "embedding" not in tickets.columns:
        tickets = tickets.withColumn("embedding", F.lit(None).cast(vectors.schema["embedding"].dataType))
    return upsert(tickets, vectors, ["account_id", "ticket_id"], ["embedding"], insert=False)


def refresh_articles(incoming: DataFrame, stored: DataFrame, build: Callable[[], Embed],
                     at: datetime, dimension: int = EMBEDDING_DIMENSION,
                     mode: str = "by_version") -> DataFrame:
    """Next version of the article table; write it beside the one read."""
    routed = route_articles(incoming, stored, mode)
    todo = routed.filter(F.col("action") == EMBEDDED).select(
        "account_id", "article_id", mask_pii(F.col("clean_text")).alias("text"))
    vectors = embed_texts(todo, "text", build, dimension).withColumn("embedded_at", F.lit(at))
    return merge_articles(stored, routed, vectors)


def centroids(leaders: LeaderPass, min_size: int = DEFAULT_MIN_SIZE) -> DataFrame:
    """Clusters that are large enough, with their mean vector."""
    count = F.col("member_count")
    return leaders.clusters.filter(count >= min_size).select(
        *leaders.keys, "cluster_id",
        F.transform("vector_sum", lambda x: x / count).alias("centroid"),
        count.alias("ticket_count"))


def member_distances(members: DataFrame, tickets: DataFrame, centers: DataFrame) -> DataFrame:
    """Members of the kept clusters with their cosine distance to the centroid.

    The vector join is on the ticket key. The centroid side has one row per
    cluster; adaptive execution broadcasts it when it is small and otherwise
    splits a cluster with most of the rows.
    """
    vectors = tickets.select("account_id", "ticket_id", "embedding")
    return (members.join(vectors, ["account_id", "ticket_id"])
            .join(centers.select(*CLUSTER, "centroid"), CLUSTER)
            .select(*CLUSTER, "ticket_id",
                    cosine_distance(F.col("embedding"), F.col("centroid")).alias("distance")))


def representative_ids(chosen: DataFrame) -> DataFrame:
    """Their ids as one short list per cluster, in id order."""
    return chosen.groupBy(*CLUSTER).agg(
        F.array_sort(F.collect_list("ticket_id")).alias("representative_ids"))


def extractive_summary(members: DataFrame, tickets: DataFrame) -> DataFrame:
    """Labels without a model: the words that set a cluster apart."""
    sizes = cluster_sizes(members)
    texts = masked_ticket_text(tickets.select("account_id", "ticket_id", "subject", "description"))
    scored = term_scores(members.join(texts, ["account_id", "ticket_id"]), sizes)
    named = sizes.join(extractive_labels(scored), CLUSTER, "left")
    count = F.col("ticket_count").cast("string")
    return named.select(
        *CLUSTER,
        F.coalesce("label", F.lit("Unlabeled topic")).alias("label"),
        F.when(F.col("label").isNull(), "").otherwise(
            F.concat(count, F.lit(" tickets about "), F.col("label"))).alias("summary"),
        F.lit(None).cast("string").alias("error"))


@dataclass(frozen=True)
class ClusteringRun:
    clusters: DataFrame
    members: DataFrame
    audit: DataFrame
    summary: DataFrame


def run_totals(leaders: LeaderPass, min_size: int = DEFAULT_MIN_SIZE) -> DataFrame:
    """Totals of every run; only the sizes of clusters are read."""
    size = F.col("member_count")
    kept = size >= min_size
    return leaders.clusters.groupBy(*RUN).agg(
        F.count_if(kept).alias("clusters_created"),
        F.coalesce(F.sum(F.when(kept, size)), F.lit(0)).alias("tickets_clustered"),
        F.coalesce(F.sum(F.when(~kept, size)), F.lit(0)).alias("tickets_unclustered"))


def cluster_runs(tickets: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                 min_size: int = DEFAULT_MIN_SIZE, generate: Callable[[], Generate] | None = None,
                 at: datetime | None = None) -> ClusteringRun:
    """Cluster, label and measure every run in ``tickets`` (embedded, stored).

    Placements and labels are written to the shared folder once, since several
    of the results read them.
    """
    spark = tickets.sparkSession
    work = work_path(spark, "clustering")
    leaders = leader_pass(tickets, threshold).saved(f"{work}/placed")

    centers = centroids(leaders, min_size)
    kept = leaders.members.join(centers.select(*CLUSTER), CLUSTER, "left_semi")
    chosen = representatives(kept, REPRESENTATIVES)
    chosen.write.parquet(f"{work}/representatives")
    chosen = spark.read.schema(chosen.schema).parquet(f"{work}/representatives")
    if generate is None:
        labels = extractive_summary(kept, tickets)
    else:
        # A few rows per cluster against all texts: do not shuffle the texts.
        labels = label_by_model(excerpts(broadcast_if_small(chosen), tickets), generate)
    # A model call must happen once, not once per result that reads its answer.
    labels.write.parquet(f"{work}/labels")
    labels = spark.read.schema(labels.schema).parquet(f"{work}/labels")

    clusters = centers.join(labels, CLUSTER, "left").join(representative_ids(chosen), CLUSTER, "left")
    stamped = F.lit(at) if at is not None else F.current_timestamp()
    return ClusteringRun(
        clusters=clusters.select(*CLUSTER, "label", "summary", "ticket_count", "centroid",
                                 "representative_ids"),
        members=member_distances(kept, tickets, centers),
        audit=failure_audit(clusters, stamped),
        summary=run_totals(leaders, min_size),
    )


def save_clustering(run: ClusteringRun, path: str, runs: DataFrame | None = None) -> int:
    """Store a clustering as one commit; returns its version.

    Members, clusters and audit rows go to folders of a fresh version. The last write is
    one small table of commits, a row for each run: until it is there readers see the
    former version, after it the new one, never parts of both. ``runs`` lists the runs
    that were asked for, so that one left without tickets is emptied too.
    """
    version = time.time_ns()
    asked = run.summary.select(*RUN) if runs is None else runs.select(*RUN).union(run.summary.select(*RUN))
    for name, table in ((MEMBERS, run.members), (CLUSTERS, run.clusters), (AUDIT, run.audit)):
        table.write.parquet(f"{path}/{name}/version={version}")
    commits = asked.distinct().withColumns({"version": F.lit(version), "committed_at": F.current_timestamp()})
    commits.coalesce(1).write.mode("append").parquet(f"{path}/{COMMITS}")
    return version


def stored_clustering(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of ``MEMBERS`` or ``CLUSTERS`` in the last committed version of each run, all
    rows of ``AUDIT`` that were committed."""
    commits = spark.read.parquet(f"{path}/{COMMITS}")
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    if name == AUDIT:
        return rows.join(commits.select("version").distinct(), "version", "left_semi").drop("version")
    last = commits.groupBy(*RUN).agg(F.max("version").alias("version"))
    return rows.join(last, [*RUN, "version"], "left_semi").drop("version")


def run_clustering(tickets: DataFrame, build: Callable[[], Embed], path: str, *, runs: DataFrame | None = None,
                   dimension: int = EMBEDDING_DIMENSION, threshold: float = DEFAULT_THRESHOLD,
                   min_size: int = DEFAULT_MIN_SIZE, generate: Callable[[], Generate] | None = None,
                   at: datetime | None = None) -> DataFrame:
    """The whole job on stored tickets: vectors for those that lack one, clusters, labels,
    one commit below ``path``. Returns each run's totals; ``tickets_without_vector`` are
    the blank ones, which no cluster can hold.

    Tickets with their vectors are stored too, as ``path/tickets`` of the same version,
    for the next job to start from.
    """
    spark = tickets.sparkSession
    vectors = embed_tickets(tickets if "embedding" in tickets.columns else tickets.withColumn(
        "embedding", F.lit(None).cast("array<float>")), build, dimension)
    # The new vectors are computed once, by the write below.
    stored = f"{path}/tickets/{time.time_ns()}"
    with_new_vectors(tickets, vectors).write.parquet(stored)
    complete = spark.read.parquet(stored)
    done = cluster_runs(complete, threshold, min_size, generate, at)
    save_clustering(done, path, runs)
    bare = needing_embedding(complete).groupBy(*RUN).agg(F.count(F.lit(1)).alias("tickets_without_vector"))
    totals = done.summary.join(bare, RUN, "full")
    if runs is not None:
        totals = totals.join(runs.select(*RUN).distinct(), RUN, "full")
    return totals.na.fill(0)


def cluster_list(clusters: DataFrame) -> DataFrame:
    """Clusters by size; equal sizes by id."""
    return clusters.select(
        *CLUSTER, "label", "summary", "ticket_count", "representative_ids",
    ).orderBy(F.desc("ticket_count"), "cluster_id")
