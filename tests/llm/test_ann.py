import numpy as np
import pytest
from pyspark.sql import functions as F

from isoplane.llm import ann as A


def brute(rows, k):
    good = set()
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.add((i, tuple(v)))
    out = {}
    for q, v in sorted(good, reverse=True):
        if q % 10 == 0:
            d = sorted((float(np.sqrt(((np.array(w, float) - np.array(v, float)) ** 2).sum())), i) for i, w in good if (i, w) != (q, v) and len(w) == len(v))
            out[q] = [(i, x) for x, i in d[:k]]
    return out


@pytest.mark.parametrize("block", [32768, 64])
def test_recall_and_exact_scores(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 24))
    rows = [(i, (centres[i % 6] + 0.6 * rng.standard_normal(24)).astype("float32").tolist()) for i in range(900)]
    rows += [(i, rows[7][1]) for i in range(900, 1000)]  # a large group of equal vectors
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (1010, [1.0, 2.0]), (1011, [1.0, 3.0]), (None, rows[0][1]), (5, [9.0] * 24), (20, [9.5] * 24), (20, rows[20][1]), (1020, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, 10)
    got = {}
    for r in A.search(df.withColumn("rank", F.lit("x")), F.col("vec_id") % 10 == 0, 10, A.Collisions(block=block)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for i, _ in want[q]})
        true = dict(want[q])
        assert all(abs(s - true[i]) < 1e-9 for _, i, s in found if i in true)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert [i for _, i, _ in got[900]] == [i for i, _ in want[900]]


def test_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = A.search(df, F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1)]
    assert A.search(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert A.search(df.limit(1), F.lit(True)).collect() == []


def test_few_vectors_are_verified(spark):
    """Random directions, where projections tell least: recall and the share of candidates that get a true distance."""
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, vectors = data["vec_id"].to_numpy(), np.stack(data["embedding"].to_numpy()).astype(float)
    index = A.Index(ids, vectors, 10, A.Collisions())
    asks = np.flatnonzero(ids % 10 == 0)
    hit = 0
    for q, found, _ in index.search(ids[asks], vectors[asks]):
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hit += len(set(ids[np.argsort(d)[:10]]) & set(found))
    assert hit >= 0.9 * 10 * len(asks)
    assert index.verified < 0.05 * len(asks) * len(ids)


def test_several_blocks_of_a_small_table(spark):
    """On the table ``embeddings``: recall and verified share over several blocks, and a result that no number of tasks changes."""
    import pyarrow.parquet as pq

    how = A.Collisions()
    assert [how.blocks(n) for n in (0, 1023, 2000, 10_256, 51_282, 400_000)] == [1, 1, 1, 8, 8, 13]
    how = A.Collisions(small=500)
    path = "/root/testdata/sf0.1/embeddings.parquet"
    table = pq.read_table(path).to_pydict()
    ids, vectors = np.array(table["vec_id"]), np.array(table["embedding"], float)
    assert how.blocks(len(ids)) == 4
    frame = spark.read.parquet(path)
    rows = lambda: sorted(tuple(r) for r in A.search(frame, F.col("vec_id") % 100 == 0, 10, how).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows() == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hit = 0
    queries = np.flatnonzero(ids % 100 == 0)
    for q in queries:
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len({int(ids[i]) for i in np.lexsort((ids, d))[:10]} & {v for i, _, v, _ in got if i == ids[q]})
    assert hit >= 0.9 * 10 * len(queries)
    verified = 0
    for part in np.array_split(np.random.default_rng(1).permutation(len(ids)), 4):
        index = A.Index(ids[part], vectors[part], 10, how)
        list(index.search(ids[queries], vectors[queries]))
        verified += index.verified
    assert verified < 0.25 * len(queries) * len(ids)
