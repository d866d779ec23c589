"""Every query against its SQL at the smallest scale."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
import workload
from check_oracles import TABLES, normal
from conftest import ROOT, SMALL

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert workload.all_queries().keys() == workload.all_sql().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_queries_and_sql_are_listed_without_a_session():
    listed = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 0"
    done = subprocess.run([sys.executable, "-c", listed], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", sorted(workload.all_queries()))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, SMALL)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cursor = tables.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert got == normal(cursor.fetchall(), names)
