"""Every registered query of the core against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from loomgraph.plans import catalog, stored  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    answer = duck.execute(catalog.SQL[name])
    at = [[x[0] for x in answer.description].index(c) for c in columns]
    assert len(answer.description) == len(columns)
    want = sorted(([plain(r[i]) for i in at] for r in answer.fetchall()), key=repr)
    assert got == want


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
