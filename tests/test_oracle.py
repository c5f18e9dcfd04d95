"""Every query beside its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, canonical
from tracelake import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = canonical([tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()])
    theirs = canonical(db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert mine == theirs


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
