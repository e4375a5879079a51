"""Every query with SQL gives the rows that the SQL gives."""

import math

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def other(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, other, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    names = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    cur = other.execute(entry.oracle_sql()[name])
    at = [d[0] for d in cur.description]
    b = sorted((tuple(plain(r[at.index(c)]) for c in names) for r in cur.fetchall()), key=repr)
    assert names == sorted(at) and a == b


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
