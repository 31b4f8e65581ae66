"""Every registered query against the same question in SQL, on whole tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from medallion.catalog import QUERIES

FOLDER = "/root/testdata/sf0.01"
ROWS_ONLY = {"model_scoring"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def _plain(value):
    return repr(round(value, 12)) if isinstance(value, float) else str(value)


def _sorted(rows, positions):
    return sorted(tuple(_plain(r[p]) for p in positions) for r in rows)


def test_only_decisions_of_a_model_have_no_oracle():
    assert set(QUERIES) - set(contract.oracle_sql()) == ROWS_ONLY
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_oracle(spark, database, name):
    df = contract.queries()[name](spark, FOLDER)
    oracle = database.sql(contract.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(oracle.columns) == names
    actual = _sorted(df.collect(), [df.columns.index(c) for c in names])
    expected = _sorted(oracle.fetchall(), [oracle.columns.index(c) for c in names])
    assert len(actual) > 0
    assert actual == expected
    assert spark.streams.active == []


def test_decisions_of_a_model_follow_the_outcome(spark, database):
    decided = dict(contract.queries()["model_scoring"](spark, FOLDER).collect())
    truth = dict(database.sql("""
        SELECT event_id, CAST((value >= 110) <> (event_id * 7919 % 40 = 0) AS INT) FROM events
        """).fetchall())
    assert 0.19 < len(decided) / len(truth) < 0.21
    positive = [i for i in decided if truth[i]]
    found = sum(decided[i] for i in positive) / len(positive)
    false = sum(decided[i] for i in decided if not truth[i]) / (len(decided) - len(positive))
    assert found > 0.6 and false < 0.25


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["ROW_NUMBER", "itemid", "description", "month", "num"]
    assert df.count() == 60
