import random

import pytest

from isoplane.operators import contours as C


def flood(free, start):
    seen, stack = {start}, [start]
    while stack:
        x, y = stack.pop()
        for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if q in free and q not in seen:
                seen.add(q)
                stack.append(q)
    return seen


def solid(pixels, n):
    """Pixels with all holes filled: what is not reached from outside by 4-connected steps."""
    free = {(x, y) for x in range(-1, n + 1) for y in range(-1, n + 1)} - pixels
    return {(x, y) for x in range(n) for y in range(n)} - flood(free, (-1, -1))


@pytest.mark.parametrize("density", [0.1, 0.4, 0.6, 0.8, 0.95])
def test_filling_traced_contours_gives_the_mask_back(spark, density):
    rng = random.Random(3)
    n = 14
    slices = {(k, z): {(x, y) for x in range(n) for y in range(n) if rng.random() < density} for k in range(4) for z in range(3)}
    mask = spark.createDataFrame([(k, x, y, z) for (k, z), p in slices.items() for x, y in p], "k long, x int, y int, z int").repartition(4)
    mask = mask.unionByName(mask.limit(5))

    def filled(nested):
        got = C.fill(C.points_of(C.trace(mask, ["k"], nested), ["k"]), ["k", "z"], least=1)
        out = {s: set() for s in slices}
        for r in got.collect():
            out[r.k, r.z].add((r.x, r.y))
        return out

    assert filled(True) == slices
    assert filled(False) == {s: solid(p, n) for s, p in slices.items()}


def test_nesting_and_corners():
    ring = {(x, y) for x in range(9) for y in range(9)} - {(x, y) for x in range(2, 7) for y in range(2, 7)}
    dot = {(4, 4), (5, 4)}
    x, y = zip(*sorted(ring | dot, key=lambda p: (p[1], p[0])))
    import numpy as np

    found = C.borders(np.array(x), np.array(y), True)
    assert [(p, h) for p, h, _ in found] == [(None, False), (0, True), (1, False)]
    assert found[0][2] == [(0, 0), (0, 8), (8, 8), (8, 0)]
    assert set(found[1][2]) == {(1, 2), (2, 1), (6, 1), (7, 2), (7, 6), (6, 7), (2, 7), (1, 6)}
    assert found[2][2] == [(4, 4), (5, 4)]
    assert [line for _, _, line in C.borders(np.array(x), np.array(y), False)] == [found[0][2]]
    assert C.borders(np.array([3]), np.array([-7]), True) == [(None, False, [(3, -7)])]


def test_fill_draws_every_edge(spark):
    rect = [(1, 0, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (6, 0), (6, 4), (0, 4)])]
    hole = [(1, 1, k, float(x), float(y)) for k, (x, y) in enumerate([(2, 1), (4, 1), (4, 3), (2, 3)])]
    line = [(1, 2, 0, 8.0, 8.0), (1, 2, 1, 9.0, 9.0)]
    steep = [(2, 0, 0, 0.0, 0.0), (2, 0, 1, 1.0, 4.0), (2, 0, 2, 0.5, 2.5), (2, 0, 3, None, 1.0)]
    points = spark.createDataFrame(rect + hole + line + steep, "k int, contour_no int, vertex_no int, px double, py double")
    got = {}
    for r in C.fill(points, ["k"]).collect():
        got.setdefault(r.k, set()).add((r.x, r.y))
    assert got[1] == {(x, y) for x in range(7) for y in range(5)} - {(3, 2)}
    assert got[2] == {(0, 0), (0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (1, 4)}
    assert {(r.x, r.y) for r in C.fill(points.where("k = 1"), ["k"], least=2).collect()} == got[1] | {(8, 8), (9, 9)}
    mask = spark.createDataFrame([(1, x, y, z, 5) for x in range(7) for y in range(7) for z in (0, 1)], "k int, x int, y int, z int, raw int")
    left = C.erase(mask, points.withColumn("z", C.F.lit(1)), ["k"]).collect()
    assert {(r.x, r.y) for r in left if r.z == 1} == {(3, 2)} | {(x, y) for x in range(7) for y in (5, 6)} and len(left) == 49 + 15
