"""Keyed writes: last write per key, column-wise merge, run replacement.

Parquet has no row-level merge. A merge is a join whose result goes to a new
place, or an append-only change log folded on read; a job never overwrites what
it reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row applied last for each key.

    An aggregate, not a window: each task sends one row per key, so a key with
    a third of all rows is no hot spot. ``order`` must be unique within a key.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)


def upsert(stored: DataFrame, updates: DataFrame, keys: Sequence[str],
           update_cols: Sequence[str], insert: bool = True) -> DataFrame:
    """Merge ``updates`` (one row per key) into ``stored``.

    A known key takes only ``update_cols``; its other columns stay as stored. A
    new key takes every column ``updates`` has, unless ``insert`` is off.
    """
    keys, update_cols = list(keys), set(update_cols)
    unknown = update_cols - set(updates.columns)
    if unknown:
        raise ValueError(f"updates lack the columns {sorted(unknown)}")
    homeless = update_cols - set(stored.columns)
    if homeless:
        raise ValueError(f"the stored table lacks the columns {sorted(homeless)}")
    old = stored.withColumn("_old", F.lit(True)).alias("old")
    new = updates.withColumn("_new", F.lit(True)).alias("new")
    joined = old.join(new, keys, "full_outer" if insert else "left")
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()

    def merged(name: str):
        if name in keys:
            return F.col(name)
        if name not in updates.columns:
            return F.col(f"old.{name}").alias(name)
        fresh, kept = F.col(f"new.{name}"), F.col(f"old.{name}")
        if name in update_cols:
            return F.when(is_new, fresh).otherwise(kept).alias(name)
        return F.when(is_old, kept).otherwise(fresh).alias(name)

    return joined.select(*[merged(name) for name in stored.columns])


def fold_changes(log: DataFrame, keys: Sequence[str], order: Sequence[str],
                 update_cols: Sequence[str]) -> DataFrame:
    """State after applying a change log of upserts in ``order``.

    ``update_cols`` come from the last change of a key, all other columns from
    the first. One shuffle, merged map-side.
    """
    keys = list(keys)
    first_cols = [c for c in log.columns if c not in {*keys, *update_cols}]
    position = F.struct(*order)
    aggregates = [F.max_by(F.struct(*update_cols), position).alias("_last")]
    if first_cols:
        aggregates.append(F.min_by(F.struct(*first_cols), position).alias("_first"))
    folded = log.groupBy(*keys).agg(*aggregates)
    wanted = [*keys, "_last.*"] + (["_first.*"] if first_cols else [])
    return folded.select(*wanted).select(*log.columns)


def without_runs(df: DataFrame, runs: DataFrame, keys: Sequence[str] = ("account_id", "run_id")) -> DataFrame:
    """Drop every row of the listed runs; apply to a table and its dependants."""
    return df.join(runs.select(*keys).distinct(), list(keys), "left_anti")


def replace_runs(stored: DataFrame, fresh: DataFrame,
                 keys: Sequence[str] = ("account_id", "run_id")) -> DataFrame:
    """Stored rows with each run in ``fresh`` replaced as a whole."""
    return without_runs(stored, fresh, keys).unionByName(fresh)


def write_runs(df: DataFrame, path: str, keys: Sequence[str] = ("account_id", "run_id")) -> None:
    """Overwrite only the (account, run) partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))


def drop_run_partitions(spark: SparkSession, path: str, runs: DataFrame,
                        keys: Sequence[str] = ("account_id", "run_id")) -> None:
    """Delete the stored partitions of runs that now have nothing to store.

    A dynamic overwrite leaves partitions alone that the new rows do not touch.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    external = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for run in runs.select(*keys).distinct().toLocalIterator():
        parts = "/".join(f"{key}={external.escapePathName(str(run[key]))}" for key in keys)
        folder = hadoop.Path(f"{path}/{parts}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
