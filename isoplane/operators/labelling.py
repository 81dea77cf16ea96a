"""26-connected components of voxel masks, labelled inside of each key by runs.

A key's voxels are one task's work as long as they are at most ``MOST`` (they are kept as runs along x, with whole
arrays at a time): one shuffle.  Larger keys are cut into slabs of slices.  Each slab is labelled alone, and components
that touch across slabs are joined by star contraction over the touching components only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoplane.checkpoints import cut

from .components import connected_components
from .groups import map_groups

#: Most voxels of a key that one task labels, and of a slab that the slices of a larger key are cut to.
MOST = 20_000_000


def join_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` nodes' components under the edges ``a, b``."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components_by_key(edges: DataFrame, key: list[str], most: int | None = None) -> DataFrame:
    """``(key, node, root)`` for the nodes of edges ``(key, a, b)``; ``root`` is the smallest node of the component in its key.

    Nodes are numbers, and of their own in each key.  A key's edges are one task's arrays, many small keys at a time, after one
    shuffle; keys of more than ``most`` edges go to star contraction.  Edges with a null end or key are left out, as are loops.
    """
    most = MOST // 4 if most is None else most
    known = edges.select(*key, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna().where("a <> b")
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", node long, root long"
    large = cut(known.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*key))

    def fn(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        n = len(pdf)
        group = np.tile(np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n])), 2)
        ends = np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()])
        order = np.lexsort((ends, group))
        g, v = group[order], ends[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
        number = np.empty(2 * n, np.int64)
        number[order] = np.cumsum(new) - 1
        root = join_labels(int(new.sum()), number[:n], number[n:])
        yield pdf.iloc[starts[g[new]]][key].assign(node=v[new], root=v[new][root])

    if large.isEmpty():
        return map_groups(known, key, fn, schema)
    node = lambda name: F.struct(*key, F.col(name).alias("node"))
    stars = connected_components(known.join(large, key, "left_semi").select(node("a").alias("a"), node("b").alias("b")))
    found = stars.select(*[F.col(f"node.{k}").alias(k) for k in key], F.col("node.node").alias("node"), F.col("root.node").alias("root"))
    return map_groups(known.join(large, key, "left_anti"), key, fn, schema).unionByName(found)


def run_components(group: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For voxels sorted by ``group, z, y, x`` without repeats: each one's run, and the first run of each run's component."""
    y, z = y - y.min(), z - z.min()
    x = x - x.min()
    rows, slices = int(y.max()) + 3, int(z.max()) + 2  # with rows and slices between that hold nothing
    row = (group * slices + z) * rows + y
    width = int(x.max()) + 4
    place = row * width + x
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1] + 1])
    run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(x)]))
    first, last, of = place[start], place[np.r_[start[1:], len(x)] - 1], row[start]
    pairs = []
    for back in (1, rows - 1, rows, rows + 1):
        # runs of the row ``back`` rows before that come within one voxel
        low = np.searchsorted(last, first - back * width - 1)
        high = np.searchsorted(first, last - back * width + 1, "right")
        count = np.maximum(high - low, 0)
        own = np.repeat(np.arange(len(start)), count)
        other = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        near = of[other] == of[own] - back
        pairs.append((own[near], other[near]))
    a, b = (np.concatenate(c) for c in zip(*pairs))
    return run, join_labels(len(start), a, b)


def label(mask: DataFrame, key: list[str], width: int, height: int, most: int | None = None) -> DataFrame:
    """``(key, x, y, z, label)``: the smallest scan index (x fastest) of the voxel's component; repeated voxels count once.

    ``x`` runs from 0 to ``width - 1`` and ``y`` to ``height - 1``; rows with a null key or coordinate are left out.
    """
    most = MOST if most is None else most
    spots = mask.select(*key, *[F.col(c).cast("int").alias(c) for c in "xyz"]).dropna()
    kinds = {f.name: f.dataType.simpleString() for f in spots.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", x int, y int, z int, label long"
    large = cut(spots.groupBy(*key).agg(F.count("*").alias("voxels"), F.min("z").alias("z0"), F.max("z").alias("z1")).where(F.col("voxels") > most))

    def labelled(by: list[str]):
        def fn(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
            n = len(pdf)
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
            x, y, z = (pdf[c].to_numpy(np.int64) for c in "xyz")
            new = np.r_[True, (group[1:] != group[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])]
            group, x, y, z = group[new], x[new], y[new], z[new]
            run, root = run_components(group, x, y, z)
            scan = x + width * (y + height * z)
            low = np.full(len(root), np.iinfo(np.int64).max)
            np.minimum.at(low, root[run], scan)
            yield pdf[new][[*by, "x", "y", "z"]].assign(label=low[root[run]])

        return fn

    if large.isEmpty():
        return map_groups(spots, key, labelled(key), schema, ["z", "y", "x"])
    small = map_groups(spots.join(large.select(*key), key, "left_anti"), key, labelled(key), schema, ["z", "y", "x"])
    thick = F.greatest(F.lit(1), F.floor((F.col("z1") - F.col("z0") + 1) * most / F.col("voxels"))).cast("int")
    slabs = spots.join(large.select(*key, "z0", thick.alias("thick")), key).withColumn("slab", F.floor((F.col("z") - F.col("z0")) / F.col("thick")).cast("int"))
    own = cut(map_groups(slabs, [*key, "slab"], labelled([*key, "slab"]), schema + ", slab int", ["z", "y", "x"]).select(*key, "slab", "x", "y", "z", "label"))
    # components that touch the next slab meet its first slice: a join on the place, as wide as a slice
    ends = own.groupBy(*key, "slab").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    edge = own.join(ends, [*key, "slab"])
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    above = edge.where("z = high").select(*key, "x", "y", (F.col("z") + 1).alias("z"), F.col("label").alias("a"), step.alias("s"))
    above = above.select(*key, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "z", "a")
    touching = above.join(edge.where("z = low").select(*key, "x", "y", "z", F.col("label").alias("b")), [*key, "x", "y", "z"]).select(*key, "a", "b").distinct()
    node = lambda name: F.struct(*key, F.col(name).alias("label"))
    roots = connected_components(touching.select(node("a").alias("a"), node("b").alias("b")))
    renamed = roots.select(*[F.col(f"node.{k}").alias(k) for k in key], F.col("node.label").alias("label"), F.col("root.label").alias("new"))
    met = own.join(renamed, [*key, "label"], "left").select(*key, "x", "y", "z", F.coalesce("new", "label").alias("label"))
    return small.unionByName(met)
