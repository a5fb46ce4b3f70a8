import math

import duckdb
import pytest

import __spark_entry__ as entry
from seqloom import queries as Q

TABLES = ["events", "documents"]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return f"{v:.6f}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", [*Q.ORACLES])
def test_queries_equal_sql(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = con.execute(Q.ORACLES[name])
    names = [d[0] for d in found.description]
    theirs = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in found.fetchall())
    assert sorted(names) == cols
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
