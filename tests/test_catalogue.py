"""Every registered query of the engine against its SQL."""

import os

import duckdb
import pytest

from tidemark import catalogue, catalogue_store  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in ("events", "lineitem", "orders"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def text(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def bag(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = db.sql(catalogue.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag(df.collect(), df.columns) == bag(want.fetchall(), columns)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_event_json_reads_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    df = catalogue.QUERIES["event_json"](spark, sf)
    got = df.collect()
    assert len(got) == c.sql("SELECT count(*) FROM events").fetchall()[0][0] == 10_000
    want = c.sql(catalogue.SQL["event_json"])
    assert bag(got, df.columns) == bag(want.fetchall(), [d[0] for d in want.description])
