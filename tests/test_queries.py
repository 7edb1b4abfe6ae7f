"""Every query with an SQL equivalent agrees with DuckDB on the smallest test tables."""

import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from codonloom.catalog.views import TABLES  # noqa: E402
from tools.check_queries import canonical  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    df = contract.queries()[name](spark, FOLDER)
    ours = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    cursor = db.execute(ORACLES[name])
    theirs = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description], dtype=object)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_every_sql_text_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


def test_entry_runs(spark):
    assert contract.entry(spark).limit(1).count() == 1
