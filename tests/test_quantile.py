import random

import duckdb
import pytest

from isoplane.operators.quantile import quantile


@pytest.mark.parametrize("most, bins, q", [(None, 64, 0.0), (None, 64, 0.95), (10, 64, 0.95), (4, 16, 0.3), (1, 64, 1.0)])
def test_matches_quantile_cont(spark, most, bins, q):
    rng = random.Random(7)
    rows = [(k, rng.choice([rng.gauss(0, 1), rng.expovariate(0.01), float(rng.randrange(5)), 3.0])) for k in range(6) for _ in range(rng.choice([1, 2, 40, 300]))]
    rows += [(7, 2.5)] * 50 + [(8, -1.0), (8, 1.0)]
    counted = spark.createDataFrame(rows + [(1, None), (9, float("nan"))], "k int, d double").groupBy("k", "d").count().withColumnRenamed("count", "n")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INTEGER, d DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = dict(con.execute(f"SELECT k, quantile_cont(d, {q}) FROM t GROUP BY k").fetchall())
    got = {r.k: r.d for r in quantile(counted, ["k"], "d", q, most, bins).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
