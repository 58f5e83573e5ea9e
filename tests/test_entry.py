import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.catalog.QUERIES]


def test_import_needs_no_session_and_no_optional_part(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import sys; sys.modules['palimpsest.llm'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); assert not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_oracles_belong_to_queries():
    assert set(entry.catalog.ORACLE_SQL) <= set(entry.catalog.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, name):
    import duckdb

    got = entry.catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name not in entry.catalog.ORACLE_SQL:
        assert len(got)
        return
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    con.sql("set memory_limit='2GB'")
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{sf_dir}/{f}')")
    want = con.sql(entry.catalog.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
