"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from topicloom.plans import catalog

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check_oracles import compare, database  # noqa: E402

FOLDER = entry.SMOKE_FOLDER

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not here")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_sql_text_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_sql(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name)
    assert ok is not False, note


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["account_id", "cluster_id", "label", "summary", "ticket_count", "representative_ids"]
    assert df.count() > 0
