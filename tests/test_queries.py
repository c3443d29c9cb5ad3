"""Every registered query of the core against its SQL, over the smallest tables."""

import math
import os

import pytest

from biosignal.plans import data_queries, signal_queries, stream_queries

FOLDER = "/root/testdata/sf0.001"
MODULES = (data_queries, signal_queries, stream_queries)
QUERIES, SQL = {k: v for m in MODULES for k, v in m.QUERIES.items()}, {k: v for m in MODULES for k, v in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) else round(v, 3)) for v in row)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=key)
    if name not in SQL:
        return
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})").fetchall()
    want = sorted(want, key=key)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)), (name, a, b)


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 5)} <= set(entry.queries())
