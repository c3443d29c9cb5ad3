import os

import pytest

from biosignal.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    rows = [tuple(r) for r in queries.QUERIES[name](spark, FOLDER).collect()]
    if name in queries.SQL:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for f in os.listdir(FOLDER):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
        assert sorted(rows) == sorted(con.sql(queries.SQL[name]).fetchall())
