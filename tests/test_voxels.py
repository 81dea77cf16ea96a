"""Masks against numpy and by their properties."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoplane.operators import components, search, voxels

ONE = (1.0, 1.0, 1.0)


def frame(spark, gt, ai, key=1):
    return spark.createDataFrame([(key, r, *v) for r, vs in (("GT", gt), ("AI", ai)) for v in vs], "k int, role string, x int, y int, z int")


@pytest.mark.parametrize("gt, ai, want", [
    ([(1, 1, 1)], [(1, 1, 1)], (1, 1, 0, 0, 0, 0)), ([(1, 1, 1)], [(2, 1, 1)], (0, 0, 1, 1, 1, 1)), ([(1, 1, 1), (2, 1, 1)], [(2, 1, 1), (3, 1, 1)], (0.5, 1 / 3, 1, 1, 0.5, 1)),
])
def test_metrics(spark, gt, ai, want):
    mask = frame(spark, gt, ai)
    o, s = voxels.overlap(mask, ["k"], ONE).first(), voxels.surface_metrics(mask, ["k"], ONE).first()
    assert np.allclose((o.dice, o.jaccard, s.hausdorff_mm, s.hd95_mm, s.assd_mm, o.com_diff_mm), want)


def test_empty_mask_is_noted(spark):
    o = voxels.overlap(frame(spark, [(0, 0, 0)], []), ["k"], ONE).first()
    assert o.note == "empty structure (no voxels)" and o.dice is None


def test_surface_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    grids = [rng.random((7, 6, 5)) < 0.4 for _ in range(2)]
    spacing = (1.0, 1.5, 3.0)

    def edge(g):
        p = np.pad(g, 1)
        inner = np.logical_and.reduce([np.roll(p, s, a) for a in range(3) for s in (1, -1)])[1:-1, 1:-1, 1:-1]
        return np.argwhere(g & ~inner) * spacing

    a, b = map(edge, grids)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    both = np.r_[d.min(1), d.min(0)]
    mask = frame(spark, *[list(map(tuple, np.argwhere(g).tolist())) for g in grids])
    s = voxels.surface_metrics(mask, ["k"], spacing).first()
    assert np.allclose((s.hausdorff_mm, s.hd95_mm, s.assd_mm), (both.max(), np.percentile(both, 95), (d.min(1).mean() + d.min(0).mean()) / 2))
    turned = voxels.surface_metrics(mask.withColumn("role", F.when(F.col("role") == "GT", "AI").otherwise("GT")), ["k"], spacing).first()
    assert np.allclose(tuple(turned), tuple(s))
    o = voxels.overlap(mask, ["k"], spacing).first()
    assert np.isclose(o.dice, 2 * o.jaccard / (1 + o.jaccard))


def test_close_z(spark):
    mask = spark.createDataFrame([(1, 0, 0, z) for z in (0, 2, 6)], "k int, x int, y int, z int")
    assert sorted(r.z for r in voxels.close_z(mask, ["k"], 1, 0, 6).collect()) == [0, 1, 2, 6]


def test_fill_and_below(spark):
    ref = spark.createDataFrame([(1, 0, x, y) for x, y in ((1, 5), (3, 7))], "k int, z int, x int, y int")
    mask = spark.createDataFrame([(1, z, x, y) for z in (0, 1) for x in range(5) for y in range(10)], "k int, z int, x int, y int")
    got = voxels.keep_below(mask, ref, ["k"], 5)
    assert {(r.z, r.x): r.y for r in got.groupBy("z", "x").agg(F.min("y").alias("y")).collect()} == {(0, 0): 6, (0, 1): 6, (0, 2): 6, (0, 3): 8, (0, 4): 8}


def test_components_match_flood_fill(spark):
    rng = np.random.default_rng(3)
    grid = rng.random((9, 8, 7)) < 0.12
    spots = {tuple(v) for v in np.argwhere(grid).tolist()}
    index = lambda v: v[0] + 9 * (v[1] + 8 * v[2])
    want, left = {}, set(spots)
    while left:
        todo, part = [left.pop()], []
        while todo:
            v = todo.pop()
            part.append(v)
            for d in itertools.product((-1, 0, 1), repeat=3):
                n = tuple(a + b for a, b in zip(v, d))
                if n in left:
                    left.remove(n)
                    todo.append(n)
        want |= {v: min(map(index, part)) for v in part}
    mask = spark.createDataFrame([(1, *v) for v in spots], "k int, x int, y int, z int")
    got = voxels.label_components(mask, ["k"], 9, 8)
    assert {(r.x, r.y, r.z): r.label for r in got.collect()} == want
    sizes = {}
    for label in want.values():
        sizes[label] = sizes.get(label, 0) + 1
    best = min(sizes, key=lambda k: (-sizes[k], k))
    assert {r.label for r in voxels.keep_largest(got, ["k"]).collect()} == {best}


def test_closing_is_extensive_and_idempotent(spark):
    rng = np.random.default_rng(5)
    mask = spark.createDataFrame([(1, *v) for v in np.argwhere(rng.random((12, 12, 2)) < 0.3).tolist()], "k int, x int, y int, z int")
    rows = lambda df: {tuple(r) for r in df.select("x", "y", "z").collect()}
    once = voxels.close_2d(mask, ["k"], 2, 12, 12)
    assert rows(mask) <= rows(once) and rows(voxels.close_2d(once, ["k"], 2, 12, 12)) == rows(once)
    assert rows(voxels.shrink(voxels.grow(mask, ["k"], 2.0, ONE), ["k"], 2.0, ONE)) >= rows(mask)


def test_connected_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(80)} | {200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_score_and_search(spark):
    dose = [(1, "PTV_1", 9.12, "Gy"), (1, "PTV_1", 780.0, "cGy"), (1, "heart", 1.0, "Gy"), (1, "liver", 99.0, "Gy"), (1, "lung_left", 50.0, "%")]
    got = search.plan_score(spark.createDataFrame(dose, "plan_no int, structure_id string, dose double, unit string")).first()
    assert abs(got.score - 100.0) < 1e-9 and got.n_goals == 3
    plans = spark.createDataFrame([(1,), (2,)], "plan_no int")
    best = search.hinge_search(plans, lambda v: F.when(F.col("plan_no") == 1, F.abs(v - 83.0))).orderBy("plan_no").collect()
    assert [(r.best_value, r.n_tried) for r in best] == [(85.0, 12), (30.0, 11)]


def _closed(spots, radius, n=16):
    kernel = voxels.ellipse(radius)
    inside = lambda x, y: 0 <= x < n and 0 <= y < n
    grown = {(x + dx, y + dy, z) for x, y, z in spots for dx, dy in kernel if inside(x + dx, y + dy)}
    return {(x, y, z) for x, y, z in grown if all((x + dx, y + dy, z) in grown for dx, dy in kernel if inside(x + dx, y + dy))}


@pytest.mark.parametrize("density", [0.1, 0.02])
def test_large_closing_matches_whole_kernel(spark, density):
    spots = {tuple(v) for v in np.argwhere(np.random.default_rng(8).random((16, 16, 2)) < density).tolist()}
    mask = spark.createDataFrame([(1, *v) for v in spots], "k int, x int, y int, z int")
    for radius in (0, 1, 5, 12):
        got = voxels.close_2d(mask, ["k"], radius, 16, 16)
        assert {(r.x, r.y, r.z) for r in got.collect()} == _closed(spots, radius)


def test_gaps_at_the_border_of_the_image_close(spark):
    """Two pixels at the border, one in the corner: outside takes no part in the erosion."""
    spots = {(0, 15, 1), (0, 12, 1), (9, 9, 1)}
    mask = spark.createDataFrame([(1, *v) for v in spots], "k int, x int, y int, z int")
    got = {(r.x, r.y, r.z) for r in voxels.close_2d(mask, ["k"], 3, 16, 16).collect()}
    assert got == _closed(spots, 3) and {(0, 13, 1), (0, 14, 1)} <= got


def test_margins_match_whole_ball(spark):
    spots = {tuple(v) for v in np.argwhere(np.random.default_rng(9).random((9, 9, 5)) < 0.7).tolist()}
    mask = spark.createDataFrame([(1, *v) for v in spots], "k int, x int, y int, z int")
    reach = [v for v in itertools.product(range(-3, 4), repeat=3) if (v[0] * 1.0) ** 2 + (v[1] * 1.5) ** 2 + (v[2] * 3.0) ** 2 <= 9]
    rows = lambda df: {(r.x, r.y, r.z) for r in df.collect()}
    assert rows(voxels.grow(mask, ["k"], 3.0, (1.0, 1.5, 3.0))) == {tuple(a + b for a, b in zip(v, d)) for v in spots for d in reach}
    small = [v for v in reach if (v[0] * 1.0) ** 2 + (v[1] * 1.5) ** 2 + (v[2] * 3.0) ** 2 <= 2.25]
    assert rows(voxels.shrink(mask, ["k"], 1.5, (1.0, 1.5, 3.0))) == {v for v in spots if all(tuple(a + b for a, b in zip(v, d)) in spots for d in small)}


def test_fixation_pipeline(spark):
    body = {(x, y, z) for x in range(4, 8) for y in range(2, 6) for z in range(2, 5)}
    stray = {(14, 1, 2)}  # drawn as body, but not part of its largest component
    ring = {(x, y) for x in range(2, 12) for y in range(9, 13) if x in (2, 11) or y in (9, 12)} - {(6, 12)}
    gear = {(*v, z) for v in ring for z in (2, 4)}  # the broken outline of a board below the body, missing in slice 3
    dust, couch = {(14, 0, 0), (5, 0, 3)}, {(x, 14, 3) for x in range(16)}
    hu = spark.createDataFrame([(1, *v, 100) for v in body] + [(1, *v, 1900) for v in gear | dust | couch], "k int, x int, y int, z int, raw int")
    only = lambda rows: spark.createDataFrame([(1, *v) for v in rows], "k int, x int, y int, z int")
    run = lambda **more: {tuple(r) for r in voxels.fixation(hu, only(body | stray), only(couch), ["k"], (16, 16, 8), ONE, coarse=F.lit(1950), refined=F.lit(1850), body_margin=1.0, **more).select("x", "y", "z").collect()}
    erase = body | couch
    found = {v for v in _closed((gear | dust | couch) - erase, 12) if 0 <= v[0] < 16 and 0 <= v[1] < 16} - erase
    found = {v for v in found if 2 <= v[2] <= 4 and v[1] > 5}
    wide = {(x, y, z + d) for x, y, z in found for d in (-1, 0, 1)}
    found |= {v for v in wide if all(not 0 <= v[2] + d < 8 or (v[0], v[1], v[2] + d) in wide for d in (-1, 0, 1))}
    near = {tuple(a + b for a, b in zip(v, d)) for v in body for d in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, d)) <= 1}
    want = body | (found - near)
    assert (6, 10, 2) in want and (5, 10, 3) in want
    assert run() == want and run(keep_bulge=True) == want


def test_rays(spark):
    mask = spark.createDataFrame([(1, 2, y, 0) for y in (3, 5, 90)], "k int, x int, y int, z int")
    assert [tuple(r) for r in voxels.surface_on_ray(mask, ["k"], 2, 0, 20).collect()] == [(1, 5)]
    assert voxels.surface_on_ray(mask, ["k"], 3, 0, 20).collect() == []


def test_surface_metrics_of_keys_with_many_distances(spark):
    rng = np.random.default_rng(3)
    spots = [(k, r, *map(int, v)) for k in range(3) for r in ("GT", "AI") for v in rng.integers(0, 9, (60, 3))]
    mask = spark.createDataFrame(sorted(set(spots)), "k int, role string, x int, y int, z int")
    rows = lambda most: sorted(tuple(round(r[c], 9) for c in ("k", "hausdorff_mm", "hd95_mm", "assd_mm")) for r in voxels.surface_metrics(mask, ["k"], (1.0, 1.5, 3.0), most).collect())
    assert rows(None) == rows(3) and len(rows(None)) == 3
