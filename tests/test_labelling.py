import random

import pytest

from isoplane.operators import labelling

W, H = 12, 9


def plain(voxels):
    """Flood fill; labels are smallest scan indices."""
    left, out = set(voxels), []
    while left:
        stack, part = [left.pop()], []
        while stack:
            k, x, y, z = stack.pop()
            part.append((k, x, y, z))
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    for dz in (-1, 0, 1):
                        q = (k, x + dx, y + dy, z + dz)
                        if q in left:
                            left.remove(q)
                            stack.append(q)
        low = min(x + W * (y + H * z) for _, x, y, z in part)
        out += [(*v, low) for v in part]
    return sorted(out)


def noise(density, seed=1, keys=7, depth=8):
    rng = random.Random(seed)
    return sorted({(k, x, y, z) for k in range(keys) for x in range(W) for y in range(H) for z in range(depth) if rng.random() < density * (1 + k % 3) / 2})


@pytest.mark.parametrize("density", [0.05, 0.12, 0.5])
@pytest.mark.parametrize("most", [None, 60, 1])
def test_matches_flood_fill(spark, density, most):
    voxels = noise(density)
    frame = spark.createDataFrame(voxels + voxels[:9], "k long, x int, y int, z int").repartition(6)
    got = labelling.label(frame, ["k"], W, H, most)
    assert sorted(tuple(r) for r in got.collect()) == plain(voxels)


def test_text_keys_nulls_and_empty(spark):
    rows = [("a", 1, 0, 0, 0), ("a", 2, 1, 1, 1), ("a", 1, 5, 5, 5), (None, 1, 0, 0, 0), ("a", 1, None, 0, 0)]
    frame = spark.createDataFrame(rows, "p string, q int, x int, y int, z int")
    got = labelling.label(frame, ["p", "q"], W, H)
    assert sorted((r.p, r.q, r.x, r.label) for r in got.collect()) == [("a", 1, 0, 0), ("a", 1, 5, 5 + W * (5 + H * 5)), ("a", 2, 1, 1 + W * (1 + H))]
    assert labelling.label(frame.where("false"), ["p", "q"], W, H).collect() == []


def test_a_long_snake_is_one_component(spark):
    """One path through every other row and slice of a key: its label must travel the whole length, and over slabs."""
    snake, end = [], 49
    for z in range(0, 60, 2):
        rows = list(range(0, 40, 2))[:: 1 if z % 4 == 0 else -1]
        for y, after in zip(rows, [*rows[1:], None]):
            snake += [(1, x, y, z) for x in range(50)]
            snake.append((1, end, y, z + 1) if after is None else (1, end, (y + after) // 2, z))
            end = 49 - end
    frame = spark.createDataFrame(snake, "k long, x int, y int, z int")
    for most in (None, 5000):
        assert [r.label for r in labelling.label(frame, ["k"], 50, 40, most).select("label").distinct().collect()] == [0]
    missing = frame.where("not (x = 25 and y = 20 and z = 30)")
    assert labelling.label(missing, ["k"], 50, 40, 5000).select("label").distinct().count() == 2


@pytest.mark.parametrize("most", [None, 15, 0])
def test_components_by_key(spark, most):
    rng = random.Random(3)
    edges = [(k, rng.randrange(25), rng.randrange(25)) for k in range(9) for _ in range(rng.choice([1, 8, 20, 40]))]
    want = {}
    for k, a, b in edges:
        for v in (a, b):
            if any(x != y and j == k and v in (x, y) for j, x, y in edges):
                want.setdefault((k, v), v)
    changed = True
    while changed:
        changed = False
        for k, a, b in edges:
            if a != b:
                low = min(want[k, a], want[k, b])
                changed |= (want[k, a], want[k, b]) != (low, low)
                want[k, a] = want[k, b] = low
    frame = spark.createDataFrame([*edges, (None, 1, 2), (3, None, 1)], "k int, a long, b int").repartition(4)
    got = labelling.components_by_key(frame, ["k"], most).collect()
    assert sorted((r.k, r.node, r.root) for r in got) == sorted((k, v, r) for (k, v), r in want.items())
    assert labelling.components_by_key(frame.where("false"), ["k"], most).collect() == []
