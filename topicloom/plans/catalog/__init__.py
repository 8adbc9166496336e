"""Registered queries with the SQL that must give the same rows."""

from topicloom.plans.catalog import clusters, feeds, reports, store, texts, vectors

_MODULES = (texts, vectors, feeds, store, clusters, reports)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
