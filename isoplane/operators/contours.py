"""Contours of masks, and masks of contours.

Tracing follows borders slice by slice: a slice is one task's work, many small slices at a time, after one shuffle.  The
borders are those of Suzuki and Abe (Computer Vision, Graphics and Image Processing 30, 1985): outer borders and holes of
8-connected pixels, each with the border around it.  Straight runs keep their corners only.

Filling follows the usual rules of an integer polygon fill: vertices are rounded to pixels (halves to even), every edge is
drawn with all its pixels, and rows are filled between pairs of crossings of all of a key's contours together, so a contour
inside of another one is a hole, though its own edge is filled.  It is all columns: each edge finds its own pixels and crossings, and only a row's
crossings meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import map_groups
from .voxels import subtract

# the eight neighbours (dy, dx), clockwise from the east, y downwards
_ROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
_EAST, _WEST = 0, 4


def _follow(f: np.ndarray, y: int, x: int, side: int, mark: int) -> list[tuple[int, int]]:
    """The border that starts at a pixel with background at ``side``, as a cycle of pixels; marks them in ``f``."""
    first = next((d for k in range(8) if f[y + _ROUND[d := (side + k) % 8][0], x + _ROUND[d][1]]), None)
    if first is None:
        f[y, x] = -mark
        return [(x, y)]
    last = (y + _ROUND[first][0], x + _ROUND[first][1])
    found, cy, cx, back = [], y, x, first
    while True:
        east = False
        for k in range(1, 9):
            d = (back - k) % 8
            ny, nx = cy + _ROUND[d][0], cx + _ROUND[d][1]
            if f[ny, nx]:
                break
            east |= d == _EAST
        if east:
            f[cy, cx] = -mark
        elif f[cy, cx] == 1:
            f[cy, cx] = mark
        found.append((cx, cy))
        if (ny, nx) == (y, x) and (cy, cx) == last:
            return found
        cy, cx, back = ny, nx, (d + 4) % 8


def corners(cycle: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pixels of a border at which its direction changes."""
    n = len(cycle)
    step = [(cycle[(k + 1) % n][0] - cycle[k][0], cycle[(k + 1) % n][1] - cycle[k][1]) for k in range(n)]
    return [p for k, p in enumerate(cycle) if n == 1 or step[k] != step[k - 1]]


def borders(x: np.ndarray, y: np.ndarray, nested: bool) -> list[tuple[int | None, bool, list[tuple[int, int]]]]:
    """``(parent, is_hole, corners)`` of a slice's borders in scan order; without ``nested`` the outermost ones only."""
    x0, y0 = int(x.min()) - 1, int(y.min()) - 1
    f = np.zeros((int(y.max()) - y0 + 2, int(x.max()) - x0 + 2), np.int32)
    f[y - y0, x - x0] = 1
    inside = f[:-2, 1:-1] * f[2:, 1:-1] * f[1:-1, :-2] * f[1:-1, 2:]
    edge_y, edge_x = np.nonzero(f[1:-1, 1:-1] * (1 - inside))
    found: list[tuple[int | None, bool, list[tuple[int, int]]]] = []
    row, seen = -1, 1  # the mark last seen in the row; 1 stands for the frame
    for cy, cx in zip((edge_y + 1).tolist(), (edge_x + 1).tolist()):
        if cy != row:
            row, seen = cy, 1
        value = int(f[cy, cx])
        outer = value == 1 and not f[cy, cx - 1]
        hole = not outer and value >= 1 and not f[cy, cx + 1]
        if nested and (outer or hole):
            if hole and value > 1:
                seen = value
            around = None if abs(seen) == 1 else abs(seen) - 2
            if around is not None and found[around][1] == hole:
                around = found[around][0]
            found.append((around, hole, corners(_follow(f, cy, cx, _WEST if outer else _EAST, len(found) + 2))))
        elif outer and not nested and (seen < 0 or seen == 1):
            found.append((None, False, corners(_follow(f, cy, cx, _WEST, len(found) + 2))))
        if abs(value := int(f[cy, cx])) != 1:
            seen = value
    return [(around, hole, [(px + x0, py + y0) for px, py in line]) for around, hole, line in found]


def trace(mask: DataFrame, key: Sequence[str], nested: bool = False) -> DataFrame:
    """``(key, z, contour_no, parent, is_hole, vertices)`` of each slice's borders.

    ``nested`` gives holes and what lies in them, each with the number of the border around it; without it only the
    outermost borders are traced.  Repeated voxels count once; rows with a null key or coordinate are left out.
    """
    slice_ = [*key, "z"]
    spots = mask.select(*key, *[F.col(c).cast("int").alias(c) for c in "xyz"]).dropna()
    kinds = {f.name: f.dataType.simpleString() for f in spots.schema}

    def fn(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        at, rows = [], []
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            for no, (around, hole, line) in enumerate(borders(x[a:b], y[a:b], nested)):
                at.append(a)
                rows.append((no, around, hole, [{"x": px, "y": py} for px, py in line]))
        found = pd.DataFrame(rows, columns=["contour_no", "parent", "is_hole", "vertices"]).astype({"parent": "Int32"})
        yield pd.concat([pdf.iloc[at][slice_].reset_index(drop=True), found], axis=1)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in slice_) + ", contour_no int, parent int, is_hole boolean, vertices array<struct<x:int,y:int>>"
    return map_groups(spots, slice_, fn, schema)


def points_of(contours: DataFrame, key: Sequence[str]) -> DataFrame:
    """The vertices of traced contours as rows ``(key, z, contour_no, vertex_no, px, py)``."""
    every = contours.select(*key, "z", "contour_no", F.posexplode("vertices").alias("vertex_no", "v"))
    return every.select(*key, "z", "contour_no", "vertex_no", F.col("v.x").cast("double").alias("px"), F.col("v.y").cast("double").alias("py"))


def fill(points: DataFrame, key: Sequence[str], least: int = 3) -> DataFrame:
    """Pixels ``(key, x, y)`` of the contours ``(key, contour_no, vertex_no, px, py)``.

    Contours of fewer than ``least`` vertices are left out, as are vertices without a place.
    """
    # working columns have names that no key should have
    contour = [*key, "contour_no"]
    order = Window.partitionBy(*contour).orderBy("vertex_no")
    pixel = F.struct(F.bround("px", 0).cast("long").alias("x"), F.bround("py", 0).cast("long").alias("y"))
    edges = (
        points.where("px is not null and py is not null").withColumn("_n", F.count("*").over(Window.partitionBy(*contour))).where(F.col("_n") >= least)
        .withColumn("_p", pixel).withColumn("_q", F.coalesce(F.lead("_p").over(order), F.first("_p").over(order)))
        .select(*key, "_p", "_q")
    )
    # every pixel of an edge, from its left end; halves stay on the side of that end
    forward = F.col("_p.x") <= F.col("_q.x")
    ends = edges.select(*key, F.when(forward, F.col("_p")).otherwise(F.col("_q")).alias("_a"), F.when(forward, F.col("_q")).otherwise(F.col("_p")).alias("_b"))
    dx, rise = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    dy = F.abs(rise)
    steps = ends.select(
        *key, "_a", (dx >= dy).alias("_flat"), F.signum(rise).cast("long").alias("_up"), F.greatest(dx, dy).alias("_long"), F.least(dx, dy).alias("_short"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(dx, dy))).alias("_k"),
    )
    aside = F.when(F.col("_long") == 0, F.lit(0).cast("long")).otherwise(F.expr("(2 * _k * _short + _long - 1) div (2 * _long)"))
    along = lambda flat: F.when(F.col("_flat") == F.lit(flat), F.col("_k")).otherwise(aside)
    drawn = steps.select(*key, (F.col("_a.x") + along(True)).alias("x"), (F.col("_a.y") + F.col("_up") * along(False)).alias("y"))
    # the rows from an edge's upper end to before its lower end, with the crossing in 65536ths of a pixel
    down = F.col("_p.y") < F.col("_q.y")
    sloped = edges.where("_p.y <> _q.y").select(*key, F.when(down, F.col("_p")).otherwise(F.col("_q")).alias("_a"), F.when(down, F.col("_q")).otherwise(F.col("_p")).alias("_b"))
    crossed = sloped.select(*key, "_a", F.expr("((_b.x - _a.x) * 65536) div (_b.y - _a.y)").alias("_slope"), F.explode(F.sequence(F.col("_a.y"), F.col("_b.y") - 1)).alias("y"))
    crossings = crossed.select(*key, "y", (F.col("_a.x") * 65536 + F.col("_slope") * (F.col("y") - F.col("_a.y"))).alias("_x"))
    rows = crossings.groupBy(*key, "y").agg(F.array_sort(F.collect_list("_x")).alias("_xs"))
    near = lambda x: F.shiftright(x + 32768, 16)
    spans = F.transform(F.sequence(F.lit(0), (F.size("_xs") / 2).cast("int") - 1), lambda i: F.sequence(near(F.get("_xs", 2 * i)), near(F.get("_xs", 2 * i + 1))))
    filled = rows.select(*key, F.explode(F.array_distinct(F.flatten(spans))).alias("x"), "y")
    return filled.unionByName(drawn).distinct().select(*key, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def erase(mask: DataFrame, points: DataFrame, key: Sequence[str]) -> DataFrame:
    """The voxels of ``mask`` outside of the contours drawn on its slices; ``points`` have ``z`` beside the key."""
    slice_ = [*key, "z"]
    return subtract(mask, fill(points, slice_), slice_, ("x", "y"))
