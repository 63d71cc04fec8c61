"""Every query with SQL gives DuckDB's rows; every other one runs and keeps its schema."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexloom.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    relation = duck.sql(ORACLE_SQL[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries())


def test_without_the_optional_subpackage():
    import subprocess
    import sys
    import textwrap

    code = """
        import sys
        sys.modules["lexloom.llm"] = None
        import __spark_entry__ as e
        assert "word_split_counts" in e.queries() and not any(n.startswith("op") for n in e.queries())
        assert not any(n.startswith("op") for n in e.oracle_sql())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=os.path.dirname(os.path.abspath(entry.__file__)), check=True, timeout=120)
