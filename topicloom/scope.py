"""Tenant and run scoping; every scoped read goes through here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scope(df: DataFrame, account_id: object, run_id: object | None = None) -> DataFrame:
    """Rows of one account, and of one run if given (partition filters)."""
    if account_id is None:
        raise ValueError("account_id is mandatory")
    df = df.filter(F.col("account_id") == F.lit(account_id))
    return df if run_id is None else df.filter(F.col("run_id") == F.lit(run_id))


def needing_embedding(tickets: DataFrame) -> DataFrame:
    return tickets.filter(F.col("embedding").isNull())


def embedded(tickets: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """Rows with a vector, ordered by ingest id (clustering is order-dependent)."""
    return tickets.filter(F.col("embedding").isNotNull()).orderBy(id_col)


def by_ids(df: DataFrame, ids: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """Rows whose id is listed; an empty list gives no rows."""
    return df.join(ids.select(id_col), id_col, "left_semi")


def tenant_by_key(tenants: DataFrame, key: str, key_col: str = "subdomain") -> DataFrame:
    return tenants.filter(F.col(key_col) == F.lit(key))


def published_and_embedded(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("embedding").isNotNull() & ~F.col("draft"))
