"""Every query with SQL against DuckDB, on the smallest tables; all others run."""

import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from lakeseek import oracles, oracles_batch, oracles_more, queries, queries_batch, queries_search, queries_tables

QUERIES = queries.QUERIES | queries_search.QUERIES | queries_tables.QUERIES | queries_batch.QUERIES
ORACLES = oracles.ORACLES | oracles_more.ORACLES | oracles_batch.ORACLES


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = Counter(tuple(map(str, r)) for r in df.select(*columns).collect())
    rows = duck.execute(ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    wanted = Counter(tuple(str(r[names.index(c)]) for c in columns) for r in rows.fetchall())
    assert found == wanted


def test_names_without_a_session():
    """The driver may list queries before it has a session."""
    import subprocess
    import sys

    root = os.path.dirname(entry.__file__)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}).returncode == 0
