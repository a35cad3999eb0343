"""The registered queries give their SQL's rows at the smallest size, and the columns the project fixes."""

from __future__ import annotations

import pytest

from tests.helpers import database, same
from voxloom.llm import queries as Q

FOUND = {
    "p3_found": ["edit_id", "az_id"], "p4_found": ["merged_id_a", "merged_id_b"], "p5_found": ["first_sample_id", "sample_id"], "p6_found": ["rec_id", "speaker_no", "first_az_id", "last_az_id"],
    "p7_found": ["rec_id", "cluster_label", "first_merged_id", "last_merged_id"], "p8_found": ["item_id", "doc_id"], "p10_found": ["doc_id", "pii_type", "pii_text"],
}


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, small, con, name):
    same(spark, small, Q.QUERIES[name], Q.SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, small, name):
    got = Q.QUERIES[name](spark, small)
    assert name not in FOUND or got.columns == FOUND[name]
    assert got.count() > 0
