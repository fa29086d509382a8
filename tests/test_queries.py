"""Each query with SQL gives the rows of its SQL, on the smallest tables (those of the subpackage llm in tests/llm)."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quaysift.plans import general, oracle, queries

SMALL = "/root/testdata/sf0.001"
SQL = oracle.SQL
QUERIES = queries.QUERIES | general.QUERIES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    found = duck.execute(SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == cols
    key = lambda r: [(v is None, str(v)) for v in r]
    want = sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in found.fetchall()), key=key)
    assert sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=key) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["run_id", "metric", "period", "flag"] and df.count() > 0


def test_entry_lists_all():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others(spark, name):
    """Queries without SQL: rows, and what must hold of them."""
    rows = QUERIES[name](spark, SMALL).collect()
    assert rows
    if name == "p5_decoded":
        assert len(rows) == sum(spark.read.parquet(f"{SMALL}/{t}.parquet").count() for t in ("financial_evidence", "financials"))
        assert all((r.common_value is None) == (r.unit is None) for r in rows)
    if name == "p5_found":
        assert len(rows) == len({(r.tbl, r.row_key) for r in rows}) and all(r.common_value is not None for r in rows)
    if name == "index_chunks":
        assert all(r.n_chars is None or r.n_chars <= 800 for r in rows if "n_chars" in r.asDict())
