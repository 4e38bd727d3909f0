"""Every registered query with SQL against DuckDB, on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from raysheaf.jobs import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return float(v) if isinstance(v, (float, decimal.Decimal)) else v


def ordered(rows):
    """Rows by their values other than floats, then by these roughly."""
    return sorted(rows, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [f"{v:.4g}" for v in r if isinstance(v, float)]))


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return a == pytest.approx(b, rel=1e-7, abs=2e-5, nan_ok=True)
    return a == b or str(a) == str(b)


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in found.collect())
    expected = ordered(tuple(map(plain, r)) for r in want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(map(same, a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
