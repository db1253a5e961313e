"""Every registered query against its SQL, and those that report convergence for it."""

import duckdb
import pytest

import __spark_entry__ as entry
from brightloom.queries.dispatch import TABLES
from tools.check import canon


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, db, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", ["ml_softmax_head"])
def test_iterations_end_by_tolerance(spark, sf_dir, name):
    rows = entry.queries()[name](spark, sf_dir).collect()
    assert rows and all(r.converged for r in rows)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "optimized_technician_id" in df.columns
