"""Every core query with SQL gives the SQL's rows; those without SQL run and give rows."""

from __future__ import annotations

import pytest

from tests.helpers import database, same
from voxloom.plans import catalog


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, small, con, name):
    same(spark, small, catalog.QUERIES[name], catalog.SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - {"connected_graph", "propagation_converged", "spanning_forest", "density_clusters", "mapper_graph"}))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.columns == ["rec_id", "speaker_label", "gap_start_ms", "gap_end_ms"] and got.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
