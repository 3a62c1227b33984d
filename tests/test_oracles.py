"""Every query that has SQL gives the same rows in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from leafmill.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(cell(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(cell(r[c]) for c in columns) for r in df.collect()]
    cursor = con.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = [tuple(cell(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 100
