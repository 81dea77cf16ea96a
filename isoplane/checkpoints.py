"""Reliable lineage cuts.

Iterative plans cut their lineage with ``DataFrame.checkpoint()``, which writes to the folder named by
``spark.checkpoint.dir``.  On a cluster that folder is shared by all machines, so a lost executor costs a re-read and
nothing else.  A local session without the setting (a unit test, a laptop) gets a folder of its own; a cluster must name one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; sets one for sessions that have none (local runs only)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        active = jsc.getCheckpointDir().get()
    else:
        active = spark.conf.get("spark.checkpoint.dir", None)
        if not active:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            active = "file://" + tempfile.mkdtemp(prefix="isoplane-checkpoint-")
        spark.sparkContext.setCheckpointDir(active)
    return active.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and return it without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
