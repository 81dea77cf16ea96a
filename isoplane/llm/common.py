"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoplane.checkpoints import cut

#: Rows handed to Python code at once; with whole documents this bounds a worker's memory.
SLICE_ROWS = 256


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the rows that no model may learn from (null ids count as held out)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with at least one task for each core: few row groups are dealt out anew, larger inputs stay as they are."""
    tasks = df._jdf.queryExecution().executedPlan().execute().getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if tasks >= cores else df.repartition(cores)


def map_slices(df: DataFrame, schema: T.StructType, fn: Callable[[pa.Table | pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply ``fn`` to slices of at most ``SLICE_ROWS`` rows of every Arrow batch; map-only, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield fn(batch.slice(at, SLICE_ROWS))

    return df.mapInArrow(run, schema)


#: Most rows of numbers that are broadcast (about 40 bytes each).
SMALL_ROWS = 500_000


def small(rows: DataFrame) -> DataFrame:
    """A narrow table, cut from its lineage and marked for a broadcast if it was counted to be small."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows


def own_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, or the first of ``wanted_1``, ``wanted_2`` … that no column in ``taken`` has (case-insensitive)."""
    low, name, k = {t.lower() for t in taken}, wanted, 0
    while name.lower() in low:
        k += 1
        name = f"{wanted}_{k}"
    return name


def quoted(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots included."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]
