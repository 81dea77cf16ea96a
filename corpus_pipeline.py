"""A training-corpus pipeline over the table ``documents``.

Five stages, each working on all that its predecessor kept, written as Parquet in the shared folder and read again, so a
lost executor costs a re-read of one stage.  All but the last return the columns of ``documents``.

1. toxicity: documents that the chain model scores 0.5 or more go;
2. near-dedup: of each component of near copies (Jaccard similarity 0.8 on five words) the document with the smallest id
   stays;
3. benchmark decontamination: documents that leak a benchmark item go;
4. secret scans: confirmed secrets are masked in the text, all documents stay;
5. mixing: documents are drawn to the target weights (``epoch`` numbers the uses of a document).

The first and the fourth stage apply trained models, which SQL cannot express: ``ORACLE_SQL`` is None, and the stages
are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isoplane.checkpoints import fresh_path
from isoplane.llm import decontaminate, mixing, neardup, secret_scan, toxicity
from isoplane.llm.common import spread, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.train())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_redaction),
    ("mixing sources to target weights", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
