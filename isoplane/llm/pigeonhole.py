"""Embedding near-duplicates by a subspace pigeonhole join: all pairs of one label with a cosine of at least a threshold.

1. *Distinct vectors*: copies of a label and vector are one row with a count, however many there are.
2. *Rotated blocks*: unit vectors are rotated at random, so that no block of dimensions is favoured, and split into
   low-dimensional blocks.  Vectors within a squared distance ``D = 2 - 2 * threshold`` are within ``D * d / dim`` in at
   least one block of ``d`` dimensions: if every block were over its share, the sum would be over ``D``.
3. *Range join*: each block is joined by itself.  Its first dimensions make a grid with cells wider than the block's
   radius; a row stands in its own cell and in those that it reaches upwards, and a pair counts only in the cell that is
   the upper one of both in each dimension, so it is met once.  The grid gets more dimensions as labels get larger.  Cells
   over ``CHUNK`` rows are dealt to chunk pairs.
4. *Verification*: of a block's candidates those that met in an earlier block are left out, which makes the union of the
   blocks' candidates one without a shuffle; all others are verified by the cosine of the original vectors in doubles.
   Links never become rows: a task adds up the copies that each of its vectors links with, and reduces the links to a
   spanning forest, which star contraction joins.

Blocks and grid change tasks and cost, never the result.

Edge cases: vectors that are null, zero or hold null or non-finite components, a null label and a null id link with
nothing (no links, their own component, kept; a null id is not kept); vectors meet only those of their own dimension; equal
vectors of one label link with each other; of copies the smallest id stands for all in the components; repeated rows are
rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoplane.checkpoints import cut
from isoplane.operators.components import connected_components

from .ann import usable
from .simhash import deal, sorted_blocks, spanning_forest, whole_blocks

#: Rows of a cell that one task compares, and candidates that it verifies at once.
CHUNK, PIECE = 8192, 1 << 15


@dataclass(frozen=True)
class Subspaces:
    """``blocks`` of dimensions, the most of a block's dimensions that make the grid, a cell's width in radii."""

    blocks: int = 8
    grid: int = 4
    cell: float = 2.0
    seed: int = 11


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def shares(dim: int, threshold: float, how: Subspaces) -> list[tuple[int, int, float]]:
    """``(first, end, squared budget)`` of each block; a little over the share, as rotated vectors are kept in floats."""
    n = min(how.blocks, dim)
    edges = [dim * k // n for k in range(n + 1)]
    total = (2 - 2 * threshold) * (1 + 1e-5) + 1e-5
    return [(a, b, total * (b - a) / dim) for a, b in zip(edges, edges[1:])]


def grid_dims(rows: int, how: Subspaces) -> int:
    """Dimensions of the grid; each one halves about the rows that meet."""
    return max(0, min(how.grid, math.ceil(math.log2(max(1, rows) / CHUNK))))


def _places(points: np.ndarray, parts: list[tuple[int, int, float]], dims: int, how: Subspaces) -> list[list[tuple[int, int, int]]]:
    """For each point its ``(block, visits, cell)``; bit ``j`` of ``visits`` is set if it only visits in dimension ``j``."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in points]
    for b, (first, end, budget) in enumerate(parts):
        radius = math.sqrt(budget) * (1 + 1e-6)
        side = radius * how.cell
        span = 2 * math.ceil(1 / side) + 4  # cells of a dimension: coordinates of unit vectors, a step up, and rounding
        own = points[:, first : min(end, first + min(dims, int(62 / math.log2(span))))]
        home = np.floor(own / side).astype(np.int64)
        reach = np.floor((own + radius) / side).astype(np.int64) > home
        for bits in itertools.product((0, 1), repeat=own.shape[1]):
            step = np.array(bits, bool)
            visits = sum(1 << j for j, bit in enumerate(bits) if bit)
            for i in np.flatnonzero((reach | ~step).all(axis=1)):
                cell = 0
                for c in home[i] + step:
                    cell = cell * span + int(c) % span
                found[i].append((b, visits, cell))
    return found


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, added up in a fixed order, so that every task gets the same bits for a pair."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += (a[:, k] - b[:, k]) ** 2
    return total


def linked(points: np.ndarray, vectors: np.ndarray, block: int, threshold: float, parts: list[tuple[int, int, float]], visits: np.ndarray, chunk: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of links ``(i, j)`` that this cell and block are the first to meet."""
    first, end, budget = parts[block]
    own = points[:, first:end]
    norms, lengths = (own**2).sum(axis=1), np.sqrt((vectors**2).sum(axis=1))
    for at in range(0, len(own), 256):
        near = norms[at : at + 256, None] + norms[None, at:] - 2 * own[at : at + 256] @ own[at:].T <= budget + 1e-6
        if not same:
            near &= chunk[at : at + 256, None] != chunk[None, at:]
        near &= (visits[at : at + 256, None] & visits[None, at:]) == 0
        i, j = np.nonzero(np.triu(near, 1))
        for k in range(0, len(i), PIECE):
            a, b = i[k : k + PIECE] + at, j[k : k + PIECE] + at
            for p, (lo, hi, most) in enumerate(parts[: block + 1]):
                met = _square(points[a, lo:hi], points[b, lo:hi]) <= most
                keep = met if p == block else ~met
                a, b = a[keep], b[keep]
            cosine = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (lengths[a] * lengths[b])
            good = cosine >= threshold
            yield a[good], b[good]


class Forest:
    """Components of the rows of one block under links that come in batches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        apart = a != b
        if apart.any():
            pairs = np.unique(np.stack([a[apart], b[apart]]), axis=1)
            for x, r in spanning_forest(*pairs):
                self.root[x] = r
            self.root = self.root[self.root]


def _compared(batches: Iterator[pd.DataFrame], threshold: float, how: Subspaces) -> Iterator[pd.DataFrame]:
    for pdf in whole_blocks(batches):
        for (_, block, _, dim, _), rows in pdf.groupby(["block", "b", "label", "dim", "cell"], sort=False):
            if len(rows) < 2:
                continue
            vectors = np.stack(rows["v"].to_numpy()).astype(float)
            scale = np.abs(vectors).max(axis=1, keepdims=True)
            vectors /= scale  # squares of very large or very small numbers stay finite; the cosine does not change
            points = np.stack(rows["p"].to_numpy()).astype(float)
            copies, low = rows["copies"].to_numpy(np.int64), rows["low"].to_numpy(np.int64)
            others, forest = np.zeros(len(rows), np.int64), Forest(len(rows))
            for i, j in linked(points, vectors, int(block), threshold, shares(int(dim), threshold, how), rows["visits"].to_numpy(np.int64), rows["chunk"].to_numpy(), bool(rows["same"].iloc[0])):
                np.add.at(others, i, copies[j])
                np.add.at(others, j, copies[i])
                forest.add(i, j)
            some = np.flatnonzero(others)
            if len(some):
                sums = pd.DataFrame({"h": rows["h"].to_numpy()[some], "g": rows["g"].to_numpy()[some], "n": others[some]})
                yield sums.assign(a=low[some], b=low[forest.root[some]])


def links(groups: DataFrame, threshold: float, how: Subspaces = Subspaces()) -> DataFrame:
    """``(h, g, n, a, b)``: copies of other vectors that vector ``(h, g)`` links with, to be summed, and forest edges ``a, b``."""
    largest = groups.groupBy("label", "dim").count().agg(F.max("count").alias("n")).first()["n"] or 0
    dims = grid_dims(largest, how)

    def rotated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                turn = turns[dim] if dim in turns else turns.setdefault(dim, rotation(int(dim), how.seed))
                vectors = np.stack(part["v"].to_numpy()).astype(float)
                vectors /= np.abs(vectors).max(axis=1, keepdims=True)
                vectors /= np.sqrt((vectors**2).sum(axis=1, keepdims=True))
                points = (vectors @ turn).astype(np.float32)
                places = _places(points.astype(float), shares(int(dim), threshold, how), dims, how)
                yield part.assign(p=list(points), places=places)

    kind = groups.schema["v"].dataType.simpleString()
    schema = f"label string, dim int, h long, g int, low long, copies long, v {kind}, p array<float>, places array<struct<b:int,visits:int,cell:long>>"
    ready = groups.select("label", "dim", "h", "g", "low", "copies", "v").mapInPandas(rotated, schema)
    placed = ready.select("*", F.inline("places")).drop("places")
    # rows alone in their cell go with the join on the cells' sizes, before any vector is copied to chunk pairs
    dealt = deal(placed, ["label", "dim", "b", "cell"], "h", most=CHUNK)
    return sorted_blocks(dealt).mapInPandas(lambda batches: _compared(batches, threshold, how), "h long, g int, n long, a long, b long")


def components(vectors: DataFrame, threshold: float = 0.93, how: Subspaces = Subspaces(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("v"))
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    rows = rows.withColumn("v", F.when(takes_part, F.col("v")))
    named = rows.withColumns({"h": F.when(takes_part, F.xxhash64("label", "v")), "g": F.when(takes_part, F.hash("label", "v"))})
    groups = named.where("h is not null").groupBy("label", "h", "g", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    groups = cut(groups.withColumn("dim", F.size("v")))
    found = cut(links(groups, threshold, how))
    sums = found.groupBy("h", "g").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select("a", "b"))
    known = (
        groups.select("h", "g", "low", "copies").join(sums, ["h", "g"], "left").where("n is not null or copies > 1")
        .join(roots.withColumnRenamed("node", "low"), "low", "left")
        .select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "low").alias("root"))
    )
    met = named.select("vec_id", "h", "g").join(known, ["h", "g"], "left")
    component = F.coalesce("root", "vec_id")
    return met.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def oracle(threshold: float = 0.93) -> str:
    """DuckDB SQL of the registered query: all pairs of a label, then the smallest id that links reach."""
    return f"""
WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT r.a AS vec_id, (SELECT count(*) FROM link WHERE link.a = r.a) AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept FROM reach r GROUP BY r.a"""
