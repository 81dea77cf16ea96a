"""Exact distances between voxel sets by a distance transform that works on one axis after the other.

The squared distance to the nearest voxel of a set is a minimum over z of a minimum over y of a minimum over x.  The first
two are taken slice by slice (each voxel knows its pair's box of queries, so a slice's plane covers no more than that), the
last plane by plane along z, where the queries meet the slices' planes of their row y.  That is two shuffles, and a task
holds the planes of one slice or row, never a whole set: no two voxels meet in a join.  Pairs whose box has no more than
``groups.CELLS`` voxels, which are most, take all three axes in one task, many pairs at a time, after one shuffle.  The sums are those
of the plain formula in the same order, so the result is the same to the last bit either way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoplane.checkpoints import cut

from . import groups
from .groups import map_groups, portions


def lower_envelope(squares: np.ndarray, step: float, axis: int = 1) -> np.ndarray:
    """The minimum along an axis of ``squares`` plus the squared distance in it; wider steps stop when none can be nearer."""
    squares = np.moveaxis(squares, axis, 1)
    out = squares.copy()
    for k in range(1, squares.shape[1]):
        far = (k * step) ** 2
        if far >= out.max(initial=0.0):
            break
        np.minimum(out[:, k:], squares[:, :-k] + far, out=out[:, k:])
        np.minimum(out[:, :-k], squares[:, k:] + far, out=out[:, :-k])
    return np.moveaxis(out, 1, axis)


def _nearest_in_rows(group: np.ndarray, y: np.ndarray, x: np.ndarray, first: np.ndarray, width: int, step: float, height: int) -> np.ndarray:
    """``(groups, height, width)``: squared distance along x to the nearest voxel of the same group and row, else infinite.

    ``group, y, x`` are sorted; ``first`` is each group's first query column.
    """
    plane = np.full((len(first), height, width), np.inf)
    line = group * height + y
    heads = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    ends = np.r_[heads[1:], len(line)]
    span = int(max(x.max(), (first + width).max()) - min(x.min(), first.min())) + 2
    low = min(int(x.min()), int(first.min()))
    ordinal = np.repeat(np.arange(len(heads)), ends - heads)
    keys = ordinal * span + (x - low)
    wanted = first[group[heads]][:, None] + np.arange(width)
    place = np.searchsorted(keys, (np.arange(len(heads))[:, None] * span + wanted - low).ravel()).reshape(len(heads), width)
    left, right = place - 1, place
    best = np.full((len(heads), width), np.inf)
    for at, inside in ((left, left >= heads[:, None]), (right, right < ends[:, None])):
        gap = ((wanted - x[np.clip(at, 0, len(x) - 1)]) * step) ** 2
        best = np.where(inside, np.minimum(best, gap), best)
    plane[group[heads], y[heads]] = best
    return plane


def nearest(points: DataFrame, key: Sequence[str], role: str, spacing: tuple[float, float, float], flip) -> DataFrame:
    """``points`` ``(key, role, x, y, z)`` with ``d``, the distance in mm to the nearest point of the same key's other role.

    ``flip`` gives the other role of a role column.  Points without any counterpart, and rows with a null key, are left out.
    """
    key = list(key)
    known = points.select(*key, role, *[F.col(c).cast("int").alias(c) for c in "xyz"]).dropna()
    length = lambda c: F.max(c).cast("double") - F.min(c) + 1
    large = cut(known.groupBy(*key).agg((length("x") * length("y") * length("z")).alias("_cells")).where(F.col("_cells") > groups.CELLS).select(*key))
    if large.isEmpty():
        return _whole(known, key, role, spacing, flip)
    rest = _whole(known.join(large, key, "left_anti"), key, role, spacing, flip)
    return rest.unionByName(_by_axes(known.join(large, key, "left_semi"), key, role, spacing, flip))


def _group_schema(known: DataFrame, key: list[str], role: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    return ", ".join(f"`{k}` {kinds[k]}" for k in [*key, role])


def _whole(known: DataFrame, key: list[str], role: str, spacing: tuple[float, float, float], flip) -> DataFrame:
    """Distances of pairs with small boxes: a pair's two sets are two dense boxes in one task."""

    def fn(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        ends = np.r_[starts[1:], len(pdf)]
        side = pdf["_first"].to_numpy().astype(np.int64)
        at = [pdf[c].to_numpy(np.int64) for c in "zyx"]
        low = [np.minimum.reduceat(v, starts) for v in at]
        size = [np.maximum.reduceat(v, starts) - a + 1 for v, a in zip(at, low)]
        for a, b in portions([np.full(len(starts), 2), *size]):
            rows = slice(starts[a], ends[b - 1])
            of = np.repeat(np.arange(b - a), ends[a:b] - starts[a:b])
            place = tuple(v[rows] - m[a:b][of] for v, m in zip(at, low))
            dense = np.full((b - a, 2, *(int(n[a:b].max()) for n in size)), np.inf)
            dense[(of, side[rows], *place)] = 0.0
            for axis, step in zip((4, 3, 2), spacing):
                dense = lower_envelope(dense, step, axis)
            d = dense[(of, 1 - side[rows], *place)]
            yield pdf.iloc[rows][[*key, role, "x", "y", "z"]].assign(d=np.sqrt(d))[np.isfinite(d)]

    sided = known.withColumn("_first", F.col(role) < flip(F.col(role)))
    return map_groups(sided, key, fn, _group_schema(known, key, role) + ", x int, y int, z int, d double")


def _by_axes(known: DataFrame, key: list[str], role: str, spacing: tuple[float, float, float], flip) -> DataFrame:
    """Distances of pairs with large boxes, slice by slice and then row by row."""
    sx, sy, sz = spacing
    box = known.groupBy(*key, role).agg(*[f(c).cast("int").alias(f"q{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))])
    asking = box.withColumn(role, flip(F.col(role)))  # the box of those that ask for this role
    group = _group_schema(known, key, role)

    def slices(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        ends = np.r_[starts[1:], len(pdf)]
        x, y = (pdf[c].to_numpy(np.int64) for c in "xy")
        q = {c: pdf[c].to_numpy(np.int64)[starts] for c in ("qx0", "qx1", "qy0", "qy1")}
        y0 = np.minimum(np.minimum.reduceat(y, starts), q["qy0"])
        height = np.maximum(np.maximum.reduceat(y, starts), q["qy1"]) - y0 + 1
        width = q["qx1"] - q["qx0"] + 1
        for a, b in portions([height, width]):
            rows = slice(starts[a], ends[b - 1])
            of = np.repeat(np.arange(b - a), ends[a:b] - starts[a:b])
            h, w = int(height[a:b].max()), int(width[a:b].max())
            plane = _nearest_in_rows(of, y[rows] - y0[a:b][of], x[rows], q["qx0"][a:b], w, sx, h)
            plane = lower_envelope(plane, sy)
            count = q["qy1"][a:b] - q["qy0"][a:b] + 1
            g = np.repeat(np.arange(b - a), count)
            row = np.arange(len(g)) - np.repeat(np.cumsum(count) - count, count) + q["qy0"][a:b][g]
            lines = plane[g, row - y0[a:b][g]]
            head = pdf.iloc[starts[a:b]][[*key, role, "z", "qx0"]].iloc[g].reset_index(drop=True)
            yield head.assign(y=row, squares=[line[:n] for line, n in zip(lines, width[a:b][g])])

    schema = f"{group}, z int, qx0 int, y int, squares array<double>"
    planes = map_groups(known.join(asking, [*key, role]), [*key, role, "z"], slices, schema, ["y", "x"])

    def columns(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        ends = np.r_[starts[1:], len(pdf)]
        z, asks = pdf["z"].to_numpy(np.int64), pdf["asks"].to_numpy(bool)
        z0 = np.minimum.reduceat(z, starts)
        depth = np.maximum.reduceat(z, starts) - z0 + 1
        x0, x = pdf["qx0"].to_numpy(), pdf["x"].to_numpy()
        squares = pdf["squares"].to_numpy()
        widths = np.array([0 if s is None else len(s) for s in squares], np.int64)
        width = np.maximum(np.maximum.reduceat(widths, starts), 1)
        first = np.maximum.reduceat(np.where(asks, -(1 << 31), x0).astype(np.int64), starts)
        for a, b in portions([depth, width]):
            rows = np.arange(starts[a], ends[b - 1])
            of = np.repeat(np.arange(b - a), ends[a:b] - starts[a:b])
            dense = np.full((b - a, int(depth[a:b].max()), int(width[a:b].max())), np.inf)
            for r, g in zip(rows[~asks[rows]], of[~asks[rows]]):
                dense[g, z[r] - z0[a + g], : widths[r]] = squares[r]
            dense = lower_envelope(dense, sz)
            mine = asks[rows]
            q, g = rows[mine], of[mine]
            g, q = g[width[a:b][g] > 0], q[width[a:b][g] > 0]
            column = x[q].astype(np.int64) - first[a:b][g]
            known_ = (first[a:b][g] > -(1 << 31)) & (column >= 0)
            q, g, column = q[known_], g[known_], column[known_]
            found = dense[g, z[q] - z0[a:b][g], column]
            yield pdf.iloc[q][[*key, role, "x", "y", "z"]].assign(x=x[q].astype(np.int64), d=np.sqrt(found))

    none = F.lit(None)
    asked = known.withColumn(role, flip(F.col(role))).select(*key, role, "z", none.cast("int").alias("qx0"), "y", none.cast("array<double>").alias("squares"), "x", F.lit(True).alias("asks"))
    met = planes.withColumn("x", none.cast("int")).withColumn("asks", F.lit(False)).unionByName(asked)
    found = map_groups(met, [*key, role, "y"], columns, f"{group}, x int, y int, z int, d double")
    return found.withColumn(role, flip(F.col(role)))
