"""Every query against its SQL twin on the smallest tables, by rounded values."""

import decimal
import math

import duckdb
import pytest

from veritide.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(request):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if v is None or isinstance(v, bool | str):
        return str(v)
    if isinstance(v, int | float):
        return "nan" if math.isnan(v) else repr(float(f"{v:.9g}") + 0.0)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = df.collect()
    if name not in catalog.ORACLES:
        return
    got = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in rows)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert mine == theirs
