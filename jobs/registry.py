"""The jobs as registered queries: each runs twice into a folder of its own and returns the output as it stands then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoplane.checkpoints import fresh_path
from isoplane.operators.comparison import METRICS
from isoplane.plans import catalogue
from jobs import contour_report, laterality_audit


def job1_laterality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = fresh_path(spark, "job1")
    for _ in range(2):
        # a pattern, as the table may be one file, which a file stream does not take by its name
        found = laterality_audit.run(spark, f"{sf_dir}/conversations.parque[t]", f"{to}/out", f"{to}/checkpoint")
    return found.drop("block")


def job2_contour_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = fresh_path(spark, "job2")
    for _ in range(2):
        found = contour_report.run(spark, sf_dir, to)
    return found.select("block", "patient_id", F.col("group_no").cast("long").alias("group_no"), "match_key", "gt_set", "gt_structure", "ai_set", "ai_structure", *[F.round(m, 6).alias(m) for m in METRICS], "note", "status")


QUERIES = {"job1_laterality_audit": job1_laterality_audit, "job2_contour_report": job2_contour_report}


def _audit_sql() -> str:
    side = catalogue.side_sql("coalesce(text, '')")
    says = lambda role, where: f"bool_or(coalesce(role = '{role}', false) AND side IN ('{where}', 'AMBIGUOUS'))"
    one = "CASE WHEN {0}_l AND {0}_r THEN 'AMBIGUOUS' WHEN {0}_l THEN 'LEFT' WHEN {0}_r THEN 'RIGHT' ELSE 'NONE' END"
    return f"""WITH s AS (SELECT conv_id, turn, role, {side} AS side FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, count(DISTINCT turn) AS turns, count(DISTINCT CASE WHEN side <> 'NONE' THEN turn END) AS sided_turns, {says('user', 'LEFT')} AS u_l, {says('user', 'RIGHT')} AS u_r,
  {says('assistant', 'LEFT')} AS a_l, {says('assistant', 'RIGHT')} AS a_r FROM s GROUP BY conv_id),
v AS (SELECT conv_id, turns, sided_turns, {one.format('u')} AS asked, {one.format('a')} AS answered FROM g)
SELECT *, CASE WHEN asked <> 'AMBIGUOUS' AND asked = answered THEN 'OK' ELSE 'WARNING' END AS verdict FROM v"""


_REPORT = catalogue.comparison_sql("patient_id, group_no, match_key, gt_set, gt_structure, ai_set, ai_structure")
ORACLES = {
    "job1_laterality_audit": _audit_sql(),
    "job2_contour_report": f"""SELECT *, CAST(floor(patient_id / 100) AS BIGINT) AS block,
  CASE WHEN note IS NOT NULL THEN 'not measured' WHEN dice < 0.7 OR hd95_mm > 3.0 THEN 'review' ELSE 'measured' END AS status FROM ({_REPORT})""",
}
