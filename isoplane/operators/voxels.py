"""Operators on sparse voxel masks: one row for each foreground voxel, keyed by any columns.

Masks stay rows, so that every operator is a join, a window or an aggregation on the key, and memory does not depend on
the grid.  Dense steps (closing) work on the columns that hold a voxel only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoplane.checkpoints import cut

from .distance import nearest
from .groups import placed
from .labelling import label
from .quantile import MOST, quantile

Key = Sequence[str]


def offsets(rows: list[tuple], names: str) -> Column:
    """A generator of literal offset rows: each input row meets every one of them, without a join."""
    cols = names.split(", ")
    return F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(cols, r)]) for r in rows]))


def threshold(hu: DataFrame, limit: Column, negative_slope: Column) -> DataFrame:
    """Voxels on the dense side of a raw limit; a negative rescale slope turns the comparison round."""
    return hu.where(F.when(negative_slope, F.col("raw") <= limit).otherwise(F.col("raw") >= limit))


def raw_limit(hounsfield: float, slope: Column, intercept: Column) -> Column:
    """A Hounsfield limit on the raw scale, so that the filter stays on the stored column."""
    return (F.lit(hounsfield) - intercept) / slope


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def _typed(rows: DataFrame, like: DataFrame, names: Sequence[str], *others: str) -> DataFrame:
    """Columns in the types that they have in ``like`` (a number that has no place there is null), and ``others`` as they are."""
    return rows.select(*[F.col(c).try_cast(like.schema[c].dataType).alias(c) for c in names], *others)


def subtract(a: DataFrame, b: DataFrame, key: Key, spot: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The rows of ``a`` at whose place ``b`` has none.

    Both meet in a window, which takes tables as they are if they are placed by ``key`` already; a join by the whole place
    would move every voxel again.
    """
    place = [*key, *spot]
    taken = _typed(b, a, place).dropna().withColumn("_taken", F.lit(True))
    met = a.withColumn("_taken", F.lit(False)).unionByName(taken, allowMissingColumns=True)
    return met.withColumn("_any", F.max("_taken").over(Window.partitionBy(*place))).where("not _any").select(*a.columns)


def border(mask: DataFrame, key: Key) -> DataFrame:
    """Voxels with a background neighbour among their six (outside of the box is background)."""
    steps = offsets([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)], "dx, dy, dz")
    # every voxel tells its neighbours of itself: inner voxels hear six
    told = mask.select("*", steps).select(*key, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), (F.col("z") + F.col("dz")).alias("z"))
    heard = told.groupBy(*key, "x", "y", "z").agg(F.count("*").alias("n")).where("n = 6")
    return subtract(mask, heard, key)


def overlap(mask: DataFrame, key: Key, spacing: tuple[float, float, float]) -> DataFrame:
    """Counts, DICE, Jaccard, volumes and centroid distance of the roles GT and AI of each key; nulls and a note if one is empty."""
    sx, sy, sz = spacing
    both = mask.groupBy(*key, "x", "y", "z").agg(F.max((F.col("role") == "GT").cast("long")).alias("g"), F.max((F.col("role") == "AI").cast("long")).alias("a"))
    mean = lambda c, w: F.sum(F.col(c) * F.col(w)) / F.nullif(F.sum(w), F.lit(0))
    sums = both.groupBy(*key).agg(
        F.sum("g").alias("cg"), F.sum("a").alias("ca"), F.sum(F.col("g") * F.col("a")).alias("both"), F.count("*").alias("either"),
        *[mean(c, w).alias(f"{w}{c}") for c in "xyz" for w in "ga"],
    )
    valid = (F.col("cg") > 0) & (F.col("ca") > 0)
    cc = sx * sy * sz / 1000
    square = sum((((F.col(f"a{c}") - F.col(f"g{c}")) * s) ** 2 for c, s in zip("xyz", spacing)), F.lit(0.0))
    out = {
        "dice": 2 * F.col("both") / (F.col("cg") + F.col("ca")), "jaccard": F.col("both") / F.col("either"), "volume_gt_cc": F.col("cg") * cc,
        "volume_ai_cc": F.col("ca") * cc, "volume_diff_cc": (F.col("ca") - F.col("cg")) * cc, "com_diff_mm": F.sqrt(square),
    }
    return sums.select(*key, "cg", "ca", *[F.when(valid, e).alias(n) for n, e in out.items()], F.when(~valid, "empty structure (no voxels)").alias("note"))


def directed_distances(mask: DataFrame, key: Key, spacing: tuple[float, float, float]) -> DataFrame:
    """For each border voxel of a role its exact distance to the other role's border, in mm: ``(key, role, x, y, z, d)``."""
    edge = placed(cut(border(mask, [*key, "role"])), list(key))  # for the boxes, the slices and the queries
    return nearest(edge, key, "role", spacing, lambda role: F.when(role == "GT", "AI").otherwise("GT"))


def surface_metrics(mask: DataFrame, key: Key, spacing: tuple[float, float, float], most: int | None = None) -> DataFrame:
    """Hausdorff, its 95th percentile over both directed sets together, and the mean of the two mean distances.

    Equal distances are counted before they are shuffled; keys of more than ``most`` different ones take the quantile that
    narrows its range first, so no task holds them all.
    """
    most = MOST if most is None else most
    counted = cut(directed_distances(mask, key, spacing).groupBy(*key, "role", "d").agg(F.count("*").alias("n")))
    largest = counted.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    own = lambda r: F.sum(F.when(F.col("role") == r, F.col("d") * F.col("n"))) / F.sum(F.when(F.col("role") == r, F.col("n")))
    others = [F.max("d").alias("hausdorff_mm"), ((own("GT") + own("AI")) / 2).alias("assd_mm")]
    if largest <= most:
        return counted.groupBy(*key).agg(*others, F.percentile("d", F.lit(0.95), F.col("n")).alias("hd95_mm"))
    both = counted.groupBy(*key, "d").agg(F.sum("n").alias("n"))
    return counted.groupBy(*key).agg(*others).join(quantile(both, key, "d", 0.95, most).withColumnRenamed("d", "hd95_mm"), list(key))


@dataclass(frozen=True)
class Grid:
    """An image grid: origin in mm, direction cosines of its three axes, spacing in mm, and size in voxels."""

    origin: tuple[float, float, float]
    directions: tuple[tuple[float, float, float], ...]
    spacing: tuple[float, float, float]
    size: tuple[int, int, int]


def oriented_box(low: Sequence[Column], extent: Sequence[Column], grid: Grid) -> tuple[dict[str, Column], Column]:
    """The index box ``x0`` to ``z1`` of a box in mm, and whether there is one: it has bounds and reaches into the image.

    It is that of all eight corners through the direction cosines, so it holds for turned images, clamped to the image.  A
    place is a sum with one term for each axis of the patient, so the outermost corners take the outermost terms.
    """
    sides = {}
    for axis, name in enumerate("xyz"):
        ends = [F.lit(0.0), F.lit(0.0)]
        for c in range(3):
            terms = [(at - F.lit(grid.origin[c])) * F.lit(grid.directions[axis][c]) for at in (low[c], low[c] + extent[c])]
            ends = [ends[0] + F.least(*terms), ends[1] + F.greatest(*terms)]
        sides[f"{name}0"] = F.greatest(F.floor(ends[0] / F.lit(grid.spacing[axis])), F.lit(0)).cast("long")
        sides[f"{name}1"] = F.least(F.ceil(ends[1] / F.lit(grid.spacing[axis])), F.lit(grid.size[axis] - 1)).cast("long")
    known = F.lit(True)
    for c in (*low, *extent):
        known = known & c.isNotNull()
    for name in "xyz":
        known = known & (sides[f"{name}1"] >= sides[f"{name}0"])
    return sides, F.coalesce(known, F.lit(False))


def index_box(corners: DataFrame, key: Key, size: tuple[int, int, int], pad: int = 1) -> DataFrame:
    """The padded index box of the points ``px, py, pz`` (in voxels) of each key, clamped to the image."""
    aggregates = []
    for c, n in zip("xyz", size):
        aggregates += [
            F.greatest(F.floor(F.min(f"p{c}")) - pad, F.lit(0)).alias(f"{c}0"),
            F.least(F.ceil(F.max(f"p{c}")) + pad, F.lit(n - 1)).alias(f"{c}1"),
        ]
    return corners.groupBy(*key).agg(*aggregates)


def close_z(mask: DataFrame, key: Key, radius: int, first: int, last: int) -> DataFrame:
    """One-dimensional closing along z within the slices ``first`` to ``last``; windows are clipped there."""
    column = [*key, "x", "y"]
    dense = (
        mask.where(F.col("z").between(first, last))
        .groupBy(*column).agg(F.collect_set("z").alias("zs"))
        .select(*column, "zs", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("z"))
        .select(*column, "z", F.array_contains("zs", F.col("z")).cast("int").alias("v"))
    )
    near = Window.partitionBy(*column).orderBy("z").rowsBetween(-radius, radius)
    closed = dense.withColumn("v", F.max("v").over(near)).withColumn("v", F.min("v").over(near)).where("v = 1").select(*column, "z")
    return union(closed, mask.select(*column, "z"))


def ellipse(radius: int) -> list[tuple[int, int]]:
    """The offsets of an elliptical kernel of diameter ``2 r + 1``, row by row as image libraries draw it."""
    found = []
    for dy in range(-radius, radius + 1):
        half = round(radius * (1 - (dy / radius) ** 2) ** 0.5) if radius else 0
        found += [(dx, dy) for dx in range(-half, half + 1)]
    return found


def runs(mask: DataFrame, key: Key) -> DataFrame:
    """The mask's runs ``(key, z, y, a, b)`` along x, from ``a`` to ``b`` inclusive."""
    row = [*key, "z", "y"]
    island = F.col("x") - F.row_number().over(Window.partitionBy(*row).orderBy("x"))
    found = mask.select(*row, "x").distinct().withColumn("island", island)
    return found.groupBy(*row, "island").agg(F.min("x").alias("a"), F.max("x").alias("b")).drop("island")


def _shifted(lines: DataFrame, key: Key, kernel: list[tuple], wider: int) -> DataFrame:
    """Each run at every row ``(dy, dz, half)`` of the kernel, longer (or shorter, ``wider`` = -1) by ``half`` at both ends."""
    met = lines.select("*", offsets(kernel, "dy, dz, half"))
    a, b = F.col("a") - wider * F.col("half"), F.col("b") + wider * F.col("half")
    return met.select(*key, (F.col("z") + F.col("dz")).alias("z"), (F.col("y") + F.col("dy")).alias("y"), a.alias("a"), b.alias("b")).where("a <= b")


def dilate(lines: DataFrame, key: Key, kernel: list[tuple]) -> DataFrame:
    """The runs of a dilation: one row for each run and kernel row, not for each voxel and kernel voxel."""
    row = [*key, "z", "y"]
    order = Window.partitionBy(*row).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    moved = _shifted(lines, key, kernel, 1).withColumn("opens", F.coalesce(F.col("a") > reach + 1, F.lit(True)).cast("int"))
    joined = moved.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*row, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def erode(lines: DataFrame, key: Key, kernel: list[tuple]) -> DataFrame:
    """The voxels of an erosion with a point-symmetric kernel: those that a shortened run of every kernel row covers."""
    row = [*key, "z", "y"]
    ends = F.inline(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("v")), F.struct((F.col("b") + 1).alias("x"), F.lit(-1).alias("v"))))
    turns = _shifted(lines, key, kernel, -1).select(*row, ends).groupBy(*row, "x").agg(F.sum("v").alias("v"))
    order = Window.partitionBy(*row).orderBy("x")
    covered = turns.withColumn("n", F.sum("v").over(order)).withColumn("next", F.lead("x").over(order)).where(F.col("n") == len(kernel))
    return covered.select(*row, F.explode(F.sequence(F.col("x"), F.col("next") - 1)).alias("x"))


def voxels_of(lines: DataFrame) -> DataFrame:
    return lines.select("*", F.explode(F.sequence("a", "b")).alias("x")).drop("a", "b")


def ball(margin_mm: float, spacing: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """The rows ``(dy, dz, half)`` of a Euclidean ball."""
    sx, sy, sz = spacing
    found = []
    for dz in range(-int(margin_mm / sz), int(margin_mm / sz) + 1):
        for dy in range(-int(margin_mm / sy), int(margin_mm / sy) + 1):
            left = margin_mm**2 + 1e-9 - (dy * sy) ** 2 - (dz * sz) ** 2
            if left >= 0:
                found.append((dy, dz, int(left**0.5 / sx)))
    return found


def close_2d(mask: DataFrame, key: Key, radius: int, width: int, height: int) -> DataFrame:
    """Two-dimensional closing of each slice with the elliptical kernel, on the image's grid.

    What is outside of the image takes no part: a pixel stays if all of its kernel that lies inside was reached, so gaps at
    the image's border close as others do.  That is an erosion with everything outside set.
    """
    kernel = [(dy, 0, max(x for x, y in ellipse(radius) if y == dy)) for dy in range(-radius, radius + 1)]
    grown = dilate(runs(mask, key), key, kernel).where(F.col("y").between(0, height - 1) & (F.col("b") >= 0) & (F.col("a") < width))
    far = width + 2 * radius
    inner = grown.withColumn("a", F.when(F.col("a") <= 0, -far).otherwise(F.col("a"))).withColumn("b", F.when(F.col("b") >= width - 1, far).otherwise(F.col("b")))
    # an island that does not reach the border leaves what is beyond it to a run of its own
    slices = grown.select(*key, "z").distinct()
    rows = slices.select(*key, "z", F.explode(F.sequence(F.lit(-radius), F.lit(height - 1 + radius))).alias("y"))
    beyond = F.when((F.col("y") < 0) | (F.col("y") >= height), F.array(F.struct(F.lit(-far).alias("a"), F.lit(far).alias("b")))).otherwise(
        F.array(F.struct(F.lit(-far).alias("a"), F.lit(-1).alias("b")), F.struct(F.lit(width).alias("a"), F.lit(far).alias("b")))
    )
    outside = rows.select(*key, "z", "y", F.inline(beyond))
    whole = dilate(inner.select(*key, "z", "y", "a", "b").unionByName(outside), key, [(0, 0, 0)])  # runs that meet become one
    found = erode(whole, key, kernel)
    return found.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def grow(mask: DataFrame, key: Key, margin_mm: float, spacing: tuple[float, float, float]) -> DataFrame:
    """Euclidean dilation by a margin in mm."""
    return voxels_of(dilate(runs(mask, key), key, ball(margin_mm, spacing)))


def shrink(mask: DataFrame, key: Key, margin_mm: float, spacing: tuple[float, float, float]) -> DataFrame:
    """Euclidean erosion: voxels whose whole ball lies in the mask."""
    return erode(runs(mask, key), key, ball(margin_mm, spacing))


def keep_below(mask: DataFrame, reference: DataFrame, key: Key, width: int) -> DataFrame:
    """Voxels strictly below (greater y than) the reference's lowest row of their column.

    Columns without a reference take the nearest one to the left, then to the right; slices without any are cleared.
    """
    slice_ = [*key, "z"]
    bottom = reference.groupBy(*slice_, "x").agg(F.max("y").alias("b"))
    columns = bottom.select(*slice_).distinct().select(*slice_, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    order = Window.partitionBy(*slice_).orderBy("x")
    left = F.last("b", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("b", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    # unions, windows and groupings leave rows where they are if they are placed by the key
    every = columns.unionByName(bottom.where(F.col("x").between(0, width - 1)), allowMissingColumns=True).groupBy(*slice_, "x").agg(F.max("b").alias("b"))
    cut = every.select(*slice_, "x", F.coalesce(left, right).alias("_cut"))
    met = mask.unionByName(_typed(cut, mask, [*slice_, "x"], "_cut").dropna(), allowMissingColumns=True)
    return met.withColumn("_cut", F.max("_cut").over(Window.partitionBy(*slice_, "x"))).where("y > _cut").select(*mask.columns)


def label_components(mask: DataFrame, key: Key, width: int, height: int) -> DataFrame:
    """26-connected components: ``label`` is the smallest scan index (x fastest) of the component's voxels."""
    return label(mask, list(key), width, height)


def drop_small(labelled: DataFrame, key: Key, least: int) -> DataFrame:
    """Voxels of components of at least ``max(1, least)`` voxels."""
    size = F.count("*").over(Window.partitionBy(*key, "label"))
    return labelled.withColumn("_n", size).where(F.col("_n") >= max(1, least)).drop("_n")


def keep_largest(labelled: DataFrame, key: Key) -> DataFrame:
    """Voxels of the largest component of each key; of equal ones the first in scan order."""
    sized = labelled.withColumn("_n", F.count("*").over(Window.partitionBy(*key, "label")))
    best = F.first("label").over(Window.partitionBy(*key).orderBy(F.desc("_n"), "label"))
    return sized.withColumn("_best", best).where("label = _best").drop("_n", "_best")


def to_patient(x: Column, y: Column, z: Column, origin: tuple, directions: tuple, spacing: tuple) -> list[Column]:
    """Patient coordinates of a voxel index."""
    return [F.lit(origin[i]) + sum((c * (directions[k][i] * spacing[k]) for k, c in enumerate((x, y, z))), F.lit(0.0)) for i in range(3)]


def to_index(px: Column, py: Column, pz: Column, origin: tuple, directions: tuple, spacing: tuple) -> list[Column]:
    """Voxel index of patient coordinates; halves round to even."""
    return [F.bround(sum(((p - F.lit(o)) * (directions[k][i] / spacing[k]) for i, (p, o) in enumerate(zip((px, py, pz), origin))), F.lit(0.0)), 0).cast("int") for k in range(3)]


# Radii of the closing in pixels, of the one that fills gaps, and of the latter along z in slices.
CLOSE_RADIUS, FILL_RADIUS, FILL_RADIUS_Z = 2, 12, 1


def _dealt(rows: DataFrame, key: Key, tasks: int | None) -> DataFrame:
    """A step's rows, written and dealt by their key again: each operator of a stage holds pages of its own until the stage ends."""
    return rows if tasks is None else cut(rows).repartition(tasks, *key)


def segment(hu: DataFrame, key: Key, shape: tuple[int, int, int], limit: Column, erase: DataFrame, below: DataFrame | None = None, least: int = 0,
            fill_gaps: bool = False, span: DataFrame | None = None, negative_slope: Column | None = None, tasks: int | None = None) -> DataFrame:
    """Dense voxels as a cleaned mask.

    In this order: voxels on the dense side of the raw ``limit`` in the slices ``z0`` to ``z1`` of ``span``, less
    ``erase``; closed in each slice; ``erase`` taken away again where the closing ran into it; only what is below
    ``below``; closed along z (``fill_gaps`` only, which also takes the larger radius); components of ``least`` voxels.
    """
    width, height, depth = shape
    spots = [*key, "x", "y", "z"]
    found = threshold(hu, limit, F.lit(False) if negative_slope is None else negative_slope)
    if span is not None:
        found = found.join(span, list(key)).where("z between z0 and z1")
    found = close_2d(_dealt(subtract(found.select(*spots), erase, key), key, tasks), key, FILL_RADIUS if fill_gaps else CLOSE_RADIUS, width, height).select(*spots)
    found = subtract(_dealt(found, key, tasks), erase, key).select(*spots)
    if below is not None:
        found = keep_below(found, below, key, width).select(*spots)
    if fill_gaps:
        found = close_z(_dealt(found, key, tasks), key, FILL_RADIUS_Z, 0, depth - 1).select(*spots)
    if least > 0:
        found = drop_small(_dealt(label_components(found, key, width, height), key, tasks), key, least)
    return _dealt(found.select(*spots), key, tasks)


def fixation(hu: DataFrame, body: DataFrame, couch: DataFrame, key: Key, shape: tuple[int, int, int], spacing: tuple[float, float, float],
             coarse: Column, refined: Column, least: int = 4, z_reach: int = 10, body_margin: float = 10.0, keep_bulge: bool = False,
             negative_slope: Column | None = None, tasks: int | None = None) -> DataFrame:
    """The two-pass segmentation of fixation gear; returns the final body mask.  ``coarse`` and ``refined`` are raw limits.

    The body is reduced to its largest component first.  Refined pass: what is dense and below that body, less body and
    couch, gaps filled, less the body grown by ``body_margin``.  The coarse pass (dense voxels outside of the body within
    ``z_reach`` slices of it) only serves to place the couch, so it is made and joined with ``keep_bulge`` only.

    ``tasks`` is the number that ``hu``, ``body`` and ``couch`` are dealt to by ``key``, if they are; then each step is written and dealt so.
    """
    width, height, depth = shape
    spots = [*key, "x", "y", "z"]
    clean = _dealt(keep_largest(_dealt(label_components(body, key, width, height), key, tasks), key).select(*spots), key, tasks)
    gear = segment(hu, key, shape, refined, union(clean, couch.select(*spots)), clean, fill_gaps=True, negative_slope=negative_slope, tasks=tasks)
    result = union(clean, subtract(gear, grow(clean, key, body_margin, spacing), key).select(*spots))
    if not keep_bulge:
        return result
    span = clean.groupBy(*key).agg((F.min("z") - z_reach).alias("z0"), (F.max("z") + z_reach).alias("z1"))
    return union(result, segment(hu, key, shape, coarse, clean, least=least, span=span, negative_slope=negative_slope, tasks=tasks))


def outline(mask: DataFrame, key: Key) -> DataFrame:
    """The outer pixels of each slice: those with a background neighbour among their four."""
    steps = offsets([(1, 0), (-1, 0), (0, 1), (0, -1)], "dx, dy")
    told = mask.select("*", steps).select(*key, "z", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    return subtract(mask, told.groupBy(*key, "z", "x", "y").agg(F.count("*").alias("n")).where("n = 4"), key)


def surface_on_ray(mask: DataFrame, key: Key, x: int, z: int, centre: int, reach: int = 50) -> DataFrame:
    """The largest y of the mask on the ray through (x, z), within ``reach`` of ``centre``; keys whose ray misses are left out."""
    return mask.where((F.col("x") == x) & (F.col("z") == z) & F.col("y").between(centre - reach, centre + reach)).groupBy(*key).agg(F.max("y").alias("surface"))


def bounds_report(mask: DataFrame, key: Key, spacing: tuple[float, float, float]) -> DataFrame:
    """Index bounds, voxel count and volume in cc of each key."""
    cc = spacing[0] * spacing[1] * spacing[2] / 1000
    return mask.groupBy(*key).agg(*[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))], F.count("*").alias("voxels"), (F.count("*") * cc).alias("volume_cc"))
