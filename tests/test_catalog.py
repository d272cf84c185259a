"""Every query against its SQL in DuckDB, on the smallest tables."""
import duckdb
import pytest

from recallgrid.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES + ["conversations"]:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.SQL:
        assert rows
        return
    got = duck.execute(catalog.SQL[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    text = lambda r: tuple(map(str, r))
    assert sorted(text([r[c] for c in cols]) for r in rows) == sorted(map(text, got.fetchall()))
