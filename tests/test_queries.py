"""Every registered checklist query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from fieldmark.operators.graph import components
from fieldmark.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(str(tuple("~" if v is None else round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    mine = registry.queries()[name](spark, DATA)
    theirs = duck.sql(registry.oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert plain(mine.select(*columns).collect()) == plain(theirs.select(*[f'"{c}"' for c in columns]).fetchall())


def test_components_of_chains_stars_and_nothing(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, k) for k in range(101, 120)] + [(5, 5), (1, 2)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links, "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 100 for i in range(100, 120)}}
    assert components(links.filter("a < 0"), "a", "b").count() == 0
