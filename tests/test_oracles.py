"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from cairnway.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    want = duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in out.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(map(plain, got), key=repr) == sorted(map(plain, want), key=repr)
