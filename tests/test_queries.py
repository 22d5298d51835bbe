"""Every registered query against its SQL, and what their plans must not contain."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test data")

QUERIES = contract.QUERIES
ORACLE = contract.ORACLE_SQL


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def comparable(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in r)) for r in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_and_no_slow_operators(spark, database, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for slow in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert slow not in plan
    columns = sorted(frame.columns)
    ours = [tuple(r) for r in frame.select(*columns).collect()]
    listed = ", ".join(f'"{c}"' for c in columns)
    theirs = database.execute(f"SELECT {listed} FROM ({ORACLE[name]})").fetchall()
    assert comparable(ours) == comparable(theirs)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_the_corpus_is_scanned_in_one_narrow_pass(spark):
    """Rules need one read of the files and no shuffle."""
    plan = QUERIES["misconfig_findings"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("FileScan parquet") == 2  # planted files and texts, once each
