"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if v != v else v for v in r) for r in frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _rows(got), _rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or (isinstance(p, float) and isinstance(q, (int, float)) and abs(p - q) <= 1e-6 * max(1, abs(q)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_knn_matched_ties_and_nulls(spark, tmp_path):
    """Prices that many parts share at one distance on both sides, the lower one with the larger or the smaller keys; nulls; lone parts."""
    shared = [(100 * place + i if size else 1000 - 100 * place - i, size, 10.0 + place) for size in (0, 1) for place in range(3) for i in range(4 + 4 * (place != 1))]
    few = [(2001, 2, 10.0), (2002, 2, None), (2003, 3, None), (2004, 3, None), (2005, 4, 10.0), (2006, None, 10.0), (2007, None, 11.0), (None, 1, 11.0), (2008, 5, 10.0), (2009, 5, 12.0), (2010, 5, None)]
    spark.createDataFrame(shared + few, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    got, want = QUERIES["knn_matched"](spark, str(tmp_path)).toPandas(), con.execute(SQL["knn_matched"]).df()
    assert len(want) == 47 and _rows(got) == _rows(want)
