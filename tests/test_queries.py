"""Every registered query against its SQL, on the smallest driver tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
UNWANTED = (
    "CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
)
# The training-text queries have tests of their own.
QUERIES, SQL = contract.QUERIES, contract.SQL

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        return f"{value:.6f}" if isinstance(value, float) else str(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, database, name):
    frame = QUERIES[name](spark, FOLDER)
    expected = database.sql(SQL[name])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for operator in UNWANTED:
        assert operator not in plan
    assert sorted(frame.columns) == sorted(expected.columns)
    ours = normal([tuple(r) for r in frame.collect()], frame.columns)
    theirs = normal(expected.fetchall(), expected.columns)
    assert ours == theirs
    assert ours, "an empty result checks nothing"


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns[-1] == "dependency_path" and not frame.isEmpty()
    assert set(SQL) == set(QUERIES) <= set(contract.queries())
