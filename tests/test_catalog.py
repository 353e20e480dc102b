"""Every query of the catalog against its SQL in DuckDB."""

import duckdb
import pytest

from ragloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    by_value = lambda row: [(x is not None, x) for x in row]  # noqa: E731 - nulls first
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=by_value)
    if name in catalog.ORACLE:
        want = duck.sql(catalog.ORACLE[name])
        assert sorted(want.columns) == columns
        assert rows == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=by_value)
    else:
        assert rows
