"""The registered jobs against their SQL, on the smallest tables."""

import duckdb
import pytest

from jobs.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    order = [columns.index(n) for n in sorted(columns)]
    want = sorted(repr(tuple(r[i] for i in order)) for r in got.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r[n] for n in sorted(columns))) for r in df.collect()) == want
