"""Every query with SQL agrees with DuckDB; entry() runs. The fitted queries are covered in test_models."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_registry_covers_the_oracles():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and sum(r["n_pairs"] for r in rows) == 6000


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, name, SF_DIR) == ""


def test_model_queries_fit_the_full_sizes():
    from pairsight.operators.models import LearnerSettings
    from pairsight.plans import queries as registered

    assert registered.SETTINGS == LearnerSettings() and registered.REPLICATES == 20
