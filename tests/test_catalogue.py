"""Every registered reference query against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from isoplane.plans import catalogue, records

SF = "/root/testdata/sf0.001"


def rows_of(df):
    names = sorted(df.columns)
    return sorted(repr(tuple(r[n] for n in names)) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "supplier", "nation", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


ORACLES, QUERIES = {**catalogue.ORACLES, **records.ORACLES}, {**catalogue.QUERIES, **records.QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = duck.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    order = [columns.index(n) for n in sorted(columns)]
    want = sorted(repr(tuple(r[i] for i in order)) for r in got.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
