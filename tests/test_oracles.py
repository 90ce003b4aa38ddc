"""Every query with a SQL twin against DuckDB on the smallest tables; the others give rows with stable columns."""

import datetime
import math

import duckdb
import pytest

from heatloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 3e-5 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    relation = con.sql(f"SELECT {names} FROM ({registry.oracle_sql()[name]})")
    assert sorted(relation.columns) == columns
    key = lambda r: tuple((x is None, str(round(x, 3)) if isinstance(x, float) else str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    want = sorted((tuple(plain(v) for v in r) for r in relation.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, name):
    # kriging learns from 200 points or more, which the smallest table doesn't hold outside a block
    sf = "/root/testdata/sf0.01" if name == "block_cv" else SF
    assert registry.queries()[name](spark, sf).count() > 0
