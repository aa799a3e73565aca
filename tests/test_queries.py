"""Every core query with SQL, run over the smallest tables and compared with DuckDB."""

import math
import os

import pytest

from codeloom.plans.oracles import SQL
from codeloom.plans.queries import QUERIES

FOLDER = os.environ.get("CODELOOM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{FOLDER}/{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    QUERIES[name](spark, FOLDER).collect()


def test_the_package_stands_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['codeloom.llm'] = None\nimport __spark_entry__ as e; assert e.queries() and e.oracle_sql() and 'p8_ids' not in e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
