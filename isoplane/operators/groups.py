"""Work on whole groups of rows inside a task, many small groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of the dense arrays that are worked on at once; a group of more cells is worked on alone.
CELLS = 1 << 21


#: Rows that a task takes of a table which is dealt out anew.
ROWS = 200_000


def tasks(rows: DataFrame, most: int = ROWS) -> int:
    """How many tasks of at most about ``most`` rows a table needs that is cheap to count; one for each core at least."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def placed(rows: DataFrame, by: list, most: int = ROWS) -> DataFrame:
    """Rows that are cheap to count, dealt by their key into as many tasks as they need."""
    return rows.repartition(tasks(rows, most), *by)


def starts_of(pdf: pd.DataFrame, by: list[str]) -> np.ndarray:
    """The rows at which a group starts, in a frame sorted by ``by``."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for name in by:
        col = pdf[name].to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew, so that each holds whole groups."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        if rest and any(rest[-1][c].iloc[-1] != pdf[c].iloc[0] for c in by):
            yield pd.concat(rest, ignore_index=True)
            rest = []
        last = int(starts_of(pdf, by)[-1])
        if last:
            yield pd.concat([*rest, pdf.iloc[:last]], ignore_index=True)
            rest = []
        rest.append(pdf.iloc[last:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def map_groups(df: DataFrame, by: list[str], fn: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]], schema: str, order: list[str] | None = None) -> DataFrame:
    """``fn(frame, starts)`` over frames of whole groups of ``by``, sorted by it and ``order``; one shuffle at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, by):
            yield from fn(pdf, starts_of(pdf, by))

    # a window asks for whole groups, which rows that are placed by some of ``by`` are already; its number has to stay
    # among the columns, or it would be left out together with the shuffle
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*(order or by)))
    return df.withColumn("_number", number).sortWithinPartitions(*by, *(order or [])).mapInPandas(run, schema)


def portions(sizes: list[np.ndarray], cells: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of groups whose arrays, padded to the largest extent in each dimension, hold at most ``cells`` together."""
    cells = CELLS if cells is None else cells
    at, n = 0, len(sizes[0])
    while at < n:
        most = [np.maximum.accumulate(s[at:]) for s in sizes]
        total = np.prod(most, axis=0, dtype=np.float64) * np.arange(1, n - at + 1)
        to = at + max(1, int(np.searchsorted(total, cells, "right")))
        yield at, to
        at = to
