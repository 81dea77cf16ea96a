"""The registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoplane.checkpoints import fresh_path

from . import ann, decontaminate, langid, licences, mixing, pigeonhole, resample, secret_scan, simhash, surrogates, toxicity, warc
from .common import held_out, spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op9_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_bitsliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_documents(spark, sf_dir), width=3, radius=2)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


#: In production the key comes from the deployment's secret store.
SURROGATE_KEY = b"isoplane registered query"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(_documents(spark, sf_dir).select("doc_id", "text"), SURROGATE_KEY)


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir), secret_scan.train())


def op3_segment_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM (SELECT *, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS keeper FROM pages)
"""


def op5_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op6_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(_documents(spark, sf_dir)).select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def op7_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.classify(_documents(spark, sf_dir), licences.train())


def op8_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op11_pigeonhole_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole.components(spread(table(spark, sf_dir, "embeddings")), 0.93)


def op12_tournament_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_secret_forest": op2_secret_forest,
    "op3_segment_langid": op3_segment_langid,
    "op4_warc_dictionary": op4_warc_dictionary,
    "op5_collision_ann": op5_collision_ann,
    "op6_hierarchical_mix": op6_hierarchical_mix,
    "op7_licence_classifier": op7_licence_classifier,
    "op8_toxic_crf": op8_toxic_crf,
    "op9_template_decontam": op9_template_decontam,
    "op10_bitsliced_simhash": op10_bitsliced_simhash,
    "op11_pigeonhole_join": op11_pigeonhole_join,
    "op12_tournament_resample": op12_tournament_resample,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op4_warc_dictionary": OP4_SQL,
    "op6_hierarchical_mix": mixing.oracle(),
    "op9_template_decontam": decontaminate.oracle(),
    "op11_pigeonhole_join": pigeonhole.oracle(),
    "op12_tournament_resample": resample.oracle(),
}
