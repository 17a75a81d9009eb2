"""Every registered query against its SQL twin on the smallest tables (PAIRSPARK_SF_DIR to change)."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

FOLDER = os.environ.get("PAIRSPARK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert compare(rows, df.columns, cursor.fetchall(), columns) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["protein_id", "smiles", "prediction"]
    assert df.count() > 0
