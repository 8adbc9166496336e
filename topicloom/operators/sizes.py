"""Size-checked broadcasts, small tasks and co-located storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.session import work_path

BROADCAST_ROWS = 100_000
# Of what was shuffled, a small task reads about so many bytes; shuffles have so many parts
# at least, which are put together up to that size.
SMALL_TASK_BYTES = 8 << 20
SMALL_TASKS = 1024
ADVISORY_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
INITIAL_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if counting shows few enough rows.

    For narrow rows. Otherwise the join stays a shuffle join, which adaptive
    execution splits where a key is skewed. Hand in a stored table: counting a
    costly plan would compute it twice.
    """
    few = df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


def saved_by_small_tasks(df: DataFrame, name: str) -> DataFrame:
    """Compute a small result once, by tasks that each read little.

    For aggregates whose rows unpack to many times what is shuffled, as texts do when
    split into words: a task's memory follows what it reads. The session's own settings
    hold again afterwards.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    parts = max(SMALL_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = {ADVISORY_BYTES: str(SMALL_TASK_BYTES), INITIAL_PARTS: str(parts)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> None:
    """Store a table bucketed and sorted by its key.

    Joins and aggregations on that key then read it without a shuffle; a job
    that refreshes it writes a new table and switches readers over.
    """
    df.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
