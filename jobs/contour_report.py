"""Contour quality report: automatic structures of all patients against the ground truth.

For every patient the structures of all sets are matched by organ, each automatic one is measured against the ground truth
on the voxels of their common box, and the pairs worth a look are marked.

    python -m jobs.contour_report --tables sf0.1/ --output report/ --config jobs/contour_report.json [--patients 200 299]

Writes ``output/pairs``, one row for each pair, partitioned by ``block`` of patients, and ``output/organs``, one row for each
organ of a block: how many pairs were measured and marked, and their mean DICE.  A run recomputes whole blocks and
overwrites just their partitions (dynamic partition overwrite), so it can be repeated, or limited to the blocks of the
patients that have changed, and always leaves what one run over everything would.  A limited run takes every patient of the
blocks it touches, also those outside the given range.

``status`` is ``measured`` or ``review`` (DICE below ``least_dice`` or HD95 above ``most_hd95_mm``), or ``not measured`` with the
reason in ``note``.  Patients without a pair leave no row; a block that loses its last pair keeps its old partition, which
the log names.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoplane.operators import comparison, matching
from isoplane.operators.voxels import Grid
from isoplane.sources.views import GRID, handles, view
from jobs.settings import load, log_to_stderr

LOG = logging.getLogger("contour_report")
DEFAULTS = {"block": 100, "least_dice": 0.7, "most_hd95_mm": 3.0, "cap": 150, "origin": list(GRID.origin), "directions": [list(d) for d in GRID.directions], "spacing": list(GRID.spacing), "size": list(GRID.size)}


def pairs(structures: DataFrame, known: DataFrame, masks: DataFrame, config: dict) -> DataFrame:
    """The comparison of all matched pairs with their ``status``."""
    rows = matching.auto_match(structures).drop("gt_empty", "ai_empty")
    grid = Grid(tuple(config["origin"]), tuple(map(tuple, config["directions"])), tuple(config["spacing"]), tuple(config["size"]))
    found = comparison.compare(rows, known, masks, grid, config["cap"])
    poor = (F.col("dice") < config["least_dice"]) | F.coalesce(F.col("hd95_mm") > config["most_hd95_mm"], F.lit(False))
    return found.withColumn("status", F.when(F.col("note").isNotNull(), "not measured").when(poor, "review").otherwise("measured"))


def organs(report: DataFrame) -> DataFrame:
    measured = F.col("status") != "not measured"
    return report.groupBy("block", "match_key").agg(
        F.count("*").alias("pairs"), F.count_if(measured).alias("measured"), F.count_if(F.col("status") == "review").alias("review"), F.avg("dice").alias("mean_dice")
    )


def run(spark: SparkSession, tables: str, output: str, config: dict | None = None, patients: tuple[int, int] | None = None) -> DataFrame:
    """Recompute the blocks of ``patients`` (all, if None) and return all pairs as they stand then."""
    config = {**DEFAULTS, **(config or {})}
    block = F.floor(F.col("patient_id") / F.lit(config["block"])).cast("long")
    structures, known, masks = view(spark, tables, "structure"), handles(spark, tables), view(spark, tables, "structure_mask")
    if patients is not None:
        low, high = (p // config["block"] for p in patients)
        structures, known = structures.where(block.between(low, high)), known.where(block.between(low, high))
        masks = masks.join(known.select("handle"), "handle", "left_semi")
    report = pairs(structures, known, masks, config).withColumn("block", block)
    told, summed = f"{output}/pairs", f"{output}/organs"

    def put(rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(path)

    put(report.repartition("block"), told)
    found = spark.read.schema(report.schema).parquet(told)
    mine = found if patients is None else found.where(F.col("block").between(low, high))
    put(organs(mine), summed)
    counts = {r["status"]: r["count"] for r in mine.groupBy("status").count().collect()}
    LOG.info("read %d structures from %s; wrote to %s: %s", structures.count(), tables, told, ", ".join(f"{n} {s}" for s, n in sorted(counts.items())) or "nothing")
    if gone := sorted(r["block"] for r in mine.select("block").distinct().join(structures.select(block.alias("block")).distinct(), "block", "left_anti").collect()):
        LOG.warning("blocks without any structure keep their old partitions: %s", gone)
    return found


def main() -> None:
    args = argparse.ArgumentParser(description="Measures automatic structures against the ground truth, by organ.")
    args.add_argument("--tables", required=True, help="folder of the Parquet tables")
    args.add_argument("--output", required=True, help="folder for pairs/ and organs/")
    args.add_argument("--config", help="JSON file; see contour_report.json")
    args.add_argument("--patients", type=int, nargs=2, metavar=("FIRST", "LAST"), help="only the blocks of these patients")
    given = args.parse_args()
    log_to_stderr()
    spark = SparkSession.builder.appName("contour-report").getOrCreate()
    try:
        run(spark, given.tables, given.output, load(spark, given.config, DEFAULTS), tuple(given.patients) if given.patients else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
