import numpy as np
import pytest

from isoplane.llm import pigeonhole as P


def plain(rows, threshold=0.93):
    """All pairs; rows are (vec_id, vector, label)."""
    fit = [i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, l in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if f else None for f, (_, v, _) in zip(fit, rows)]
    n, low = [0] * len(rows), list(range(len(rows)))
    pairs = [
        (a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))
        if fit[a] and fit[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold
    ]
    ids = [i if i is not None else None for i, _, _ in rows]
    comp = list(ids)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(comp[a], comp[b])
            if (comp[a], comp[b]) != (m, m):
                comp[a] = comp[b] = m
                changed = True
    return sorted(((i, k, c, i is not None and i == c) for i, k, c in zip(ids, n, comp)), key=repr)


def cloud(dim, n=260, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    rows = []
    for i in range(n):
        noise = rng.choice([0.0, 0.05, 0.2, 0.3, 0.4, 1.0])
        v = centres[rng.integers(6)] + noise * rng.standard_normal(dim)
        rows.append((i * 3 + 5, [float(np.float32(x)) for x in v * rng.choice([0.01, 1.0, 300.0])], int(rng.integers(3))))
    rows += [(2, rows[7][1], rows[7][2]), (1, rows[7][1], rows[7][2]), (900, rows[9][1], rows[9][2]), (901, rows[9][1], None)]
    rows += [(902, None, 1), (903, [0.0] * dim, 1), (904, [1.0] * (dim - 1) + [float("nan")], 1), (905, [None] + [1.0] * (dim - 1), 1), (906, [], 1), (None, rows[7][1], 0)]
    return rows + [(907, [1.0] * (dim + 1), 1), (908, [2.0] * (dim + 1), 1), (909, [1.0] * (dim + 1), 2)]


@pytest.mark.parametrize("dim, how, chunk", [(64, P.Subspaces(), 2048), (64, P.Subspaces(cell=1.0), 8), (5, P.Subspaces(blocks=3, cell=1.3), 16), (1, P.Subspaces(), 4), (16, P.Subspaces(blocks=2, grid=8), 4)])
def test_matches_all_pairs(spark, monkeypatch, dim, how, chunk):
    monkeypatch.setattr(P, "CHUNK", chunk)
    rows = cloud(dim)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = P.components(frame, 0.93, how)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_links_at_the_threshold(spark):
    """Pairs a hair's breadth over and under the threshold, in every direction of the blocks."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(120):
        a = rng.standard_normal(24)
        b = rng.standard_normal(24)
        a, b = a / np.linalg.norm(a), b - (a @ b) * a / (a @ a)
        b /= np.linalg.norm(b)
        c = 0.93 + (1e-9 if k % 2 else -1e-9)
        rows += [(2 * k, a.tolist(), k), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), k)]
    got = {r.vec_id: r.n_links for r in P.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (i // 2) % 2 for i, _, _ in rows}


def test_large_group_of_near_copies_and_copies(spark):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(8)
    rows = [(k, (one + 0.01 * rng.standard_normal(8)).tolist(), 1) for k in range(3000)] + [(k, one.tolist(), 1) for k in range(3000, 5000)]
    got = P.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(4999, 0)} and [r.vec_id for r in got if r.kept] == [0]


def test_huge_and_tiny_numbers_empty_table_and_other_columns(spark):
    rows = [(1, [1e300, 1e300], 1, 9), (2, [1e-300, 1e-300], 1, 9), (3, [1e300, -1e300], 1, 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    got = sorted(tuple(r) for r in P.components(frame).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert P.components(frame.where("false")).collect() == []
