"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from tracklore.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    try:
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.6g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables absent")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLE:
        assert df.columns
        return
    r = duck.execute(catalog.ORACLE[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(tuple(plain(x[cols.index(c)]) for c in order) for x in r.fetchall())
    assert sorted(tuple(plain(x[c]) for c in order) for x in rows) == want
