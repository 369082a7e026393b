"""Every registered query against its SQL twin on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    if name not in SQL:
        assert got
        return
    res = duck.execute(SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in res.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["user_id", "question_id", "answer"] and df.count() > 0


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
