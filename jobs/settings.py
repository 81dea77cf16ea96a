"""What the jobs share: reading a config file through Spark, and logging."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession


def load(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """``defaults`` with what the JSON object at ``path`` (local or remote) changes; unknown names are refused."""
    if not path:
        return dict(defaults)
    found = spark.read.option("multiLine", True).json(path).first()
    given = {} if found is None else {k: v for k, v in found.asDict(recursive=True).items() if v is not None}
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return {**defaults, **given}


def log_to_stderr() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
