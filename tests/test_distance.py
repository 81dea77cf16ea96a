import random

import numpy as np
import pytest

from isoplane.operators import distance, groups, voxels

SPACING = (1.0, 1.5, 3.0)


def plain(points, spacing=SPACING):
    out = []
    for k, role, *p in points:
        others = [q for j, r, *q in points if j == k and r != role]
        if others:
            d = min((((p[0] - q[0]) * spacing[0]) ** 2 + ((p[1] - q[1]) * spacing[1]) ** 2 + ((p[2] - q[2]) * spacing[2]) ** 2) for q in others)
            out.append((k, role, *p, d**0.5))
    return sorted(out)


@pytest.mark.parametrize("cells", [1, 200, groups.CELLS])
def test_nearest_matches_all_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(groups, "CELLS", cells)
    rng = random.Random(4)
    points = set()
    for k in range(12):
        for role in ("GT", "AI"):
            at = [rng.randrange(-20, 30) for _ in range(3)]
            points |= {(k, role, *[a + rng.randrange(1 + 3 * (k % 5)) for a in at]) for _ in range(rng.choice([0, 1, 7, 60]))}
    points = sorted(points)
    frame = spark.createDataFrame(points, "k long, role string, x int, y int, z int").repartition(5)
    got = distance.nearest(frame, ["k"], "role", SPACING, lambda r: voxels.F.when(r == "GT", "AI").otherwise("GT"))
    assert sorted((r.k, r.role, r.x, r.y, r.z, r.d) for r in got.collect()) == plain(points)


def test_text_keys_several_keys_null_keys_and_empty(spark):
    rows = [("a", 1, "GT", 0, 0, 0), ("a", 1, "AI", 3, 0, 0), ("a", 2, "GT", 0, 0, 0), (None, 1, "GT", 0, 0, 0), (None, 1, "AI", 0, 0, 0)]
    frame = spark.createDataFrame(rows, "p string, q int, role string, x int, y int, z int")
    flip = lambda r: voxels.F.when(r == "GT", "AI").otherwise("GT")
    got = distance.nearest(frame, ["p", "q"], "role", SPACING, flip).collect()
    assert sorted((r.p, r.q, r.role, r.d) for r in got) == [("a", 1, "AI", 3.0), ("a", 1, "GT", 3.0)]
    assert distance.nearest(frame.where("false"), ["p", "q"], "role", SPACING, flip).collect() == []


def test_two_large_borders(spark):
    """Two spheres of about 100,000 border voxels each, one inside the other: all distances are known to a voxel."""
    cube = spark.range(225**3).selectExpr("CAST(id % 225 AS INT) - 112 AS x", "CAST(id div 225 % 225 AS INT) - 112 AS y", "CAST(id div 50625 AS INT) - 112 AS z")
    ball = cube.where("x * x + y * y + z * z <= 110 * 110")
    edge = voxels.border(ball.withColumn("k", voxels.F.lit(1)), ["k"]).select("k", voxels.F.lit("GT").alias("role"), "x", "y", "z")
    moved = edge.selectExpr("k", "'AI' AS role", "x + 5 AS x", "y", "z")
    both = edge.unionByName(moved).cache()
    assert both.count() > 200_000
    found = distance.nearest(both, ["k"], "role", (1.0, 1.0, 1.0), lambda r: voxels.F.when(r == "GT", "AI").otherwise("GT")).toPandas()
    assert len(found) == both.count() and found["d"].max() == 5.0
    # by symmetry both directions have the same distances, and one point's is checked by hand
    counts = found.groupby(["role", "d"]).size().unstack("role")
    assert (counts["GT"] == counts["AI"]).all()
    sample = found[found["role"] == "GT"].sample(300, random_state=1)
    other = found[found["role"] == "AI"][["x", "y", "z"]].to_numpy()
    for r in sample.itertuples():
        assert r.d == np.sqrt(((other - [r.x, r.y, r.z]) ** 2).sum(axis=1).min())
