"""Every query of the engine's own operators over a small folder, against DuckDB where it has SQL."""

import os

import duckdb
import pytest

from quorumscan.plans import film_queries, more_queries, queries  # noqa: F401

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    rows = sorted(map(repr, (tuple(r) for r in found.select(columns).collect())))
    if name not in queries.ORACLES:
        assert rows
        return
    result = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[k] for k in order)) for r in result.fetchall())


def test_entry_has_rows_and_every_query(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["video", "k", "start_us", "character_count", "raw_start_us"]
