"""Every query with SQL gives the same rows in DuckDB on the smallest tables."""

import math
import os

import pytest

from locusframe.plans.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return f"{value:.6g}" if type(value).__name__ == "Decimal" else str(value)


def same_rows(spark, query, sql, folder):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    got = query(spark, folder)
    assert sorted(got.columns) == sorted(names)
    rows = lambda each: sorted(tuple(map(plain, r)) for r in each)
    assert rows(got.select(*(f"`{n}`" for n in names)).collect()) == rows(want.fetchall())


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same_rows(spark, QUERIES[name], ORACLE_SQL[name], FOLDER)


@needs_tables
def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
    assert QUERIES["shards"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
