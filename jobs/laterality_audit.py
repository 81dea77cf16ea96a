"""Incremental laterality audit of written exchanges.

A treated side is stated more than once: by who asks for a plan and by who answers.  The job reads the turns of such
exchanges (``conv_id, turn, role, text``) as files arrive, finds the side that every text names, and keeps one verdict for
each exchange: do both parties name the same side?

    python -m jobs.laterality_audit --input turns/ --output audit/ --checkpoint audit-checkpoint/ --config jobs/laterality_audit.json

Each run is a file stream with ``availableNow``: it takes the files that are new since the checkpoint, and ends.  Per batch

1. the turns' sides are appended to ``output/turns``, partitioned by ``block`` (of conversation ids) and ``batch``;
2. the blocks that the batch touched are read back and their verdicts written to ``output/verdicts``, partitioned by ``block``.

Both are dynamic partition overwrites of partitions that the batch determines, so a batch that failed half way and is
taken again gives the same files, and a run without new files changes nothing.  With a lost checkpoint all files are taken
again, and as turns count once by ``(conv_id, turn)``, the verdicts are the same.  New exchanges have new ids, so blocks by
id keep the old ones untouched.

Turns without a ``conv_id`` belong to no exchange and are left out (their number is logged); a null text names no side, a null role
is neither party; a turn that comes twice counts once, with the sides of both.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoplane.functions.text import laterality, side_hits
from isoplane.operators.rules import side_verdict
from jobs.settings import load, log_to_stderr

LOG = logging.getLogger("laterality_audit")
TURNS = "conv_id long, turn long, role string, text string"
DEFAULTS = {"block": 10_000, "max_files": 200, "asks": "user", "answers": "assistant"}


def sided(turns: DataFrame, block: int) -> DataFrame:
    """``(conv_id, turn, role, side, hits, block)`` of the turns that belong to an exchange."""
    number = F.floor(F.col("conv_id") / F.lit(block)).cast("long")
    known = turns.where("conv_id is not null")
    return known.select("conv_id", "turn", "role", laterality("text").alias("side"), side_hits("text").alias("hits"), number.alias("block"))


def _named(role: str) -> Column:
    """The side that all turns of a role name together."""
    names = lambda side: F.coalesce(F.bool_or((F.col("role") == role) & F.col("side").isin(side, "AMBIGUOUS")), F.lit(False))
    return F.when(names("LEFT") & names("RIGHT"), "AMBIGUOUS").when(names("LEFT"), "LEFT").when(names("RIGHT"), "RIGHT").otherwise("NONE")


def verdicts(turns: DataFrame, asks: str, answers: str) -> DataFrame:
    """One row for each exchange: its turns, the turns that name a side, both parties' sides and the verdict."""
    sides = turns.groupBy("block", "conv_id").agg(
        F.count_distinct(F.struct("turn")).alias("turns"), F.count_distinct(F.when(F.col("side") != "NONE", F.struct("turn"))).alias("sided_turns"),
        _named(asks).alias("asked"), _named(answers).alias("answered"),
    )
    return sides.withColumn("verdict", side_verdict(F.col("asked"), F.col("answered")))


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Take what is new below ``source`` and return all verdicts as they stand then."""
    config = {**DEFAULTS, **(config or {})}
    kept, told = f"{output}/turns", f"{output}/verdicts"

    def take(batch: DataFrame, number: int) -> None:
        _replace(sided(batch, config["block"]).withColumn("batch", F.lit(number)), kept, "block", "batch")
        every = spark.read.schema(ledger.schema).parquet(kept)
        written = every.where(F.col("batch") == number)
        touched = [r["block"] for r in written.select("block").distinct().collect()]  # names of the folders just written
        found = verdicts(every.where(F.col("block").isin(touched)), config["asks"], config["answers"])
        _replace(found, told, "block")
        LOG.info("batch %d: read %d turns, wrote %d of them in %d blocks", number, batch.count(), written.count(), len(touched))

    none = sided(spark.createDataFrame([], TURNS), config["block"])
    ledger = none.withColumn("batch", F.lit(0))
    shape = verdicts(none, config["asks"], config["answers"])
    ledger.write.mode("ignore").partitionBy("block", "batch").parquet(kept)
    shape.write.mode("ignore").partitionBy("block").parquet(told)
    new = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", config["max_files"]).parquet(source)
    stream = new.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    found = spark.read.schema(shape.schema).parquet(told)
    LOG.info("%d verdicts stand in %s", found.count(), told)
    return found


def main() -> None:
    args = argparse.ArgumentParser(description="Audit of the sides that written exchanges name; takes only new files.")
    for name, text in (("input", "folder (or pattern) of Parquet files with conv_id, turn, role, text"), ("output", "folder for turns/ and verdicts/"), ("checkpoint", "folder of the stream's checkpoint")):
        args.add_argument(f"--{name}", required=True, help=text)
    args.add_argument("--config", help="JSON file; see laterality_audit.json")
    given = args.parse_args()
    log_to_stderr()
    spark = SparkSession.builder.appName("laterality-audit").getOrCreate()
    try:
        run(spark, given.input, given.output, given.checkpoint, load(spark, given.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
