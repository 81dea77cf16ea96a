"""Registered queries over planning records: look-ups, scopes, exports and checks, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoplane.checkpoints import fresh_path
from isoplane.functions import text as T
from isoplane.operators import comparison, links, matching, planning, rules
from isoplane.plans import catalogue
from isoplane.sources import exports
from isoplane.sources.views import view, view_sql
from isoplane.streaming import timed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(fn):
        QUERIES["q_" + fn.__name__] = fn
        ORACLES["q_" + fn.__name__] = sql
        return fn

    return put


def _table(spark, sf_dir, name: str, *columns: str) -> DataFrame:
    """Columns given as SQL that both engines read alike."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*columns)


# --- images, sets and plans --------------------------------------------------------------------------------------

_IMAGES = ("CAST(o_orderkey AS BIGINT) AS plan_no", "CASE WHEN o_orderkey % 3 = 0 THEN 'open' END AS open_image", "CASE WHEN o_custkey % 4 < 2 THEN o_orderstatus END AS set_image", "CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS plan_image")


@query(f"SELECT plan_no, CASE WHEN open_image IS NOT NULL THEN open_image WHEN set_image IS NOT NULL THEN set_image ELSE plan_image END AS image FROM (SELECT {', '.join(_IMAGES)} FROM orders)")
def image_of_plan(spark, sf_dir):
    return _table(spark, sf_dir, "orders", *_IMAGES).select("plan_no", planning.resolve_image(F.col("open_image"), F.col("set_image"), F.col("plan_image")).alias("image"))


_SETS = ("CAST(p_partkey AS BIGINT) AS set_no", "CASE WHEN p_size % 9 > 0 THEN p_partkey % 70 END AS image_id")
_SERIES = ("s_suppkey % 90 AS image_id", "concat('series', CAST(s_nationkey % 4 AS VARCHAR(9))) AS series_id")


@query(f"SELECT set_no FROM (SELECT {', '.join(_SETS)} FROM part) WHERE image_id IN (SELECT image_id FROM (SELECT {', '.join(_SERIES)} FROM supplier) WHERE series_id = 'series2')")
def sets_of_series(spark, sf_dir):
    return planning.sets_of_series(_table(spark, sf_dir, "part", *_SETS), _table(spark, sf_dir, "supplier", *_SERIES), "series2").select("set_no")


_SCOPED = ("CAST(o_custkey AS BIGINT) AS context", "CAST(o_orderkey AS BIGINT) AS plan_no", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 11 = 1 END AS in_scope", "CASE WHEN o_orderkey % 8 > 0 THEN o_orderkey % 3 = 0 END AS is_active")


@query(f"""WITH p AS (SELECT {', '.join(_SCOPED)} FROM orders), s AS (SELECT DISTINCT context FROM p WHERE in_scope)
SELECT context, plan_no FROM p WHERE in_scope UNION ALL SELECT context, plan_no FROM p WHERE is_active AND context NOT IN (SELECT context FROM s)""")
def plans_in_scope(spark, sf_dir):
    return planning.plans_in_scope(_table(spark, sf_dir, "orders", *_SCOPED)).select("context", "plan_no")


_TARGETED = ("CAST(o_orderkey AS BIGINT) AS plan_no", "concat(CASE WHEN o_orderkey % 2 = 0 THEN 'PTV_' ELSE 'ptv_' END, CAST(o_custkey % 60 AS VARCHAR(9))) AS target_id")
_TARGETS = ("concat('Ptv_', CAST(s_suppkey % 25 AS VARCHAR(9))) AS target_id",)


@query(f"SELECT plan_no, target_id FROM (SELECT {', '.join(_TARGETED)} FROM orders) p WHERE EXISTS (SELECT 1 FROM (SELECT {_TARGETS[0]} FROM supplier) t WHERE lower(t.target_id) = lower(p.target_id))")
def plans_of_target(spark, sf_dir):
    return planning.plans_of_target(_table(spark, sf_dir, "orders", *_TARGETED), _table(spark, sf_dir, "supplier", *_TARGETS)).select("plan_no", "target_id")


_NAMED = ("CAST(p_partkey AS BIGINT) AS part_no", "p_brand AS structure_id")
_COLOURS = ("p_brand AS structure_id", "max(p_type) AS colour")


@query("SELECT CAST(p_partkey AS BIGINT) AS part_no, p_brand AS structure_id, colour FROM part LEFT JOIN (SELECT p_brand AS brand, max(p_type) AS colour FROM part WHERE p_size % 2 = 0 AND p_brand < 'Brand#3' GROUP BY p_brand) ON brand = p_brand")
def structure_colours(spark, sf_dir):
    colours = _table(spark, sf_dir, "part", "p_brand AS structure_id", "p_type", "p_size").where("p_size % 2 = 0 and structure_id < 'Brand#3'").groupBy("structure_id").agg(F.max("p_type").alias("colour"))
    return planning.with_colours(_table(spark, sf_dir, "part", *_NAMED), colours).select("part_no", "structure_id", "colour")


_PLANS = ("CAST(o_orderkey AS BIGINT) AS plan_no", "o_custkey % 130 AS rx_id")
_FRACTIONS = ("l_suppkey % 120 AS rx_id", "CAST(round(l_extendedprice * 100) AS BIGINT) * 100 + CAST(l_quantity AS BIGINT) AS pos", "CAST(l_quantity AS INTEGER) AS fractions", "CAST(l_extendedprice AS DOUBLE) AS dose_per_fraction")


@query(f"""SELECT plan_no, CAST(p.rx_id AS BIGINT) AS rx_id, CAST(fractions AS BIGINT) AS fractions, dose_per_fraction FROM (SELECT {', '.join(_PLANS)} FROM orders) p
LEFT JOIN (SELECT * FROM (SELECT {', '.join(_FRACTIONS)} FROM lineitem) QUALIFY row_number() OVER (PARTITION BY rx_id ORDER BY pos) = 1) t ON t.rx_id = p.rx_id""")
def first_fractionation(spark, sf_dir):
    found = planning.first_fractionation(_table(spark, sf_dir, "orders", *_PLANS), _table(spark, sf_dir, "lineitem", *_FRACTIONS))
    return found.select("plan_no", F.col("rx_id").cast("long").alias("rx_id"), F.col("fractions").cast("long").alias("fractions"), "dose_per_fraction")


@query("SELECT CAST(o_custkey AS BIGINT) AS course_id, o_orderpriority AS phase_id, CAST(o_orderkey AS BIGINT) AS rx_no, o_orderstatus AS site FROM orders WHERE o_orderkey % 5 > 0")
def prescription_rows(spark, sf_dir):
    """Courses with their phases and prescriptions nested, as a record system keeps them; phases without any are empty."""
    rx = F.collect_list(F.when(F.col("o_orderkey") % 5 > 0, F.struct(F.col("o_orderkey").cast("long").alias("rx_no"), F.col("o_orderstatus").alias("site")))).alias("prescriptions")
    phases = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").cast("long").alias("course_id"), F.col("o_orderpriority").alias("phase_id")).agg(rx)
    courses = phases.groupBy("course_id").agg(F.collect_list(F.struct("phase_id", "prescriptions")).alias("phases"))
    return planning.prescription_rows(courses)


_COPIES = ("p_partkey % 300 AS set_no", "p_brand AS structure_id", "CAST(p_partkey AS BIGINT) AS version")
_NEWER = ("s_suppkey % 200 AS set_no", "concat('Brand#', CAST(10 + s_suppkey % 45 AS VARCHAR(9))) AS structure_id", "CAST(-s_suppkey AS BIGINT) AS version")


@query(f"""WITH o AS (SELECT {', '.join(_COPIES)} FROM part), n AS (SELECT {', '.join(_NEWER)} FROM supplier)
SELECT CAST(set_no AS BIGINT) AS set_no, structure_id, version FROM (SELECT * FROM o WHERE (set_no, structure_id) NOT IN (SELECT (set_no, structure_id) FROM n) UNION ALL SELECT * FROM n)""")
def replaced_copies(spark, sf_dir):
    found = planning.replace_copies(_table(spark, sf_dir, "part", *_COPIES), _table(spark, sf_dir, "supplier", *_NEWER), ["set_no", "structure_id"])
    return found.select(F.col("set_no").cast("long").alias("set_no"), "structure_id", "version")


# --- checks ------------------------------------------------------------------------------------------------------

_RUN = ("CAST(o_orderkey AS BIGINT) AS run_no", "o_orderkey % 2 = 0 AS reuse", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS open_set", "CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 2 END AS open_image",
        "CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 4 END AS image", "CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS existing", "o_custkey % 3 = 0 AS writable")


@query(f"""SELECT run_no, CASE WHEN NOT reuse THEN NULL WHEN open_set IS NULL THEN 'no open structure set' WHEN open_image IS DISTINCT FROM image THEN 'open structure set belongs to another image' END AS problem,
  CASE WHEN existing IS NULL THEN 'create' ELSE CASE writable WHEN true THEN 'reuse' ELSE 'create _ny' END END AS action FROM (SELECT {', '.join(_RUN)} FROM orders)""")
def run_checks(spark, sf_dir):
    runs = _table(spark, sf_dir, "orders", *_RUN)
    problem = planning.run_problem(F.col("reuse"), F.col("open_set"), F.col("open_image"), F.col("image"))
    return runs.select("run_no", problem.alias("problem"), planning.structure_action(F.col("existing"), F.col("writable")).alias("action"))


_MODELS = ["PhotonVolumeDose", "PhotonOptimization", "LeafMotion"]


@query("""SELECT CAST(s_suppkey AS BIGINT) AS machine, s_suppkey % 9 > 0 AND s_suppkey % 2 = 1 AND CAST(floor(s_suppkey / 2) AS BIGINT) % 2 = 1 AS has_both,
  s_suppkey % 9 > 0 AND CAST(floor(s_suppkey / 4) AS BIGINT) % 2 = 1 AS has_leaf_motion FROM supplier""")
def machine_models(spark, sf_dir):
    bit = lambda k: F.floor(F.col("s_suppkey") / (1 << k)) % 2 == 1
    own = F.when(F.col("s_suppkey") % 9 > 0, F.array_compact(F.array(*[F.when(bit(k), m) for k, m in enumerate(_MODELS)])))
    found = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("machine"), own.alias("models"))
    return found.select("machine", planning.models_available(F.col("models"), _MODELS[:2]).alias("has_both"), planning.models_available(F.col("models"), _MODELS[2:]).alias("has_leaf_motion"))


@query(view_sql("plan") + " SELECT a.plan_no, coalesce(a.orientation <> b.orientation, false) AS differs FROM v_plan a JOIN v_plan b ON b.plan_no = a.plan_no + 1")
def orientation_differs(spark, sf_dir):
    plan = view(spark, sf_dir, "plan").select("plan_no", "orientation")
    met = plan.join(plan.select((F.col("plan_no") - 1).alias("plan_no"), F.col("orientation").alias("other")), "plan_no")
    return met.select("plan_no", rules.orientation_differs(F.col("orientation"), F.col("other")).alias("differs"))


@query(view_sql("plan") + """, t AS (SELECT plan_no, 20.0 + plan_no % 141 AS hinge, CASE plan_no % 5 WHEN 0 THEN 'StaticPair' WHEN 1 THEN 'ApPaPair' WHEN 2 THEN 'VmatDualArc' WHEN 3 THEN 'Vmat' END AS technique FROM v_plan)
SELECT plan_no, CAST(start AS DOUBLE) AS start, CAST(stop AS DOUBLE) AS stop, direction, CAST(collimator AS DOUBLE) AS collimator FROM (
  SELECT plan_no, 180 - hinge / 2 AS start, 180 - hinge / 2 AS stop, 'NONE' AS direction, 0 AS collimator FROM t WHERE technique = 'StaticPair'
  UNION ALL SELECT plan_no, 180 + hinge / 2, 180 + hinge / 2, 'NONE', 0 FROM t WHERE technique = 'StaticPair' UNION ALL SELECT plan_no, g, g, 'NONE', 0 FROM t CROSS JOIN (VALUES (180), (0)) v(g) WHERE technique = 'ApPaPair'
  UNION ALL SELECT plan_no, 181, 179, 'CW', 30 FROM t WHERE coalesce(technique, '') IN ('', 'Vmat', 'VmatDualArc') UNION ALL SELECT plan_no, 179, 181, 'CCW', 330 FROM t WHERE technique = 'VmatDualArc')""")
def technique_beams(spark, sf_dir):
    k = F.col("plan_no") % 5
    technique = F.when(k == 0, "StaticPair").when(k == 1, "ApPaPair").when(k == 2, "VmatDualArc").when(k == 3, "Vmat")
    return view(spark, sf_dir, "plan").select("plan_no", F.inline(rules.plan_beams(technique, F.lit(20.0) + F.col("plan_no") % 141)))


# --- texts and exports -------------------------------------------------------------------------------------------

_VALUES = "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN CAST('NaN' AS DOUBLE) ELSE (CAST(l_suppkey AS DOUBLE) - 40) / 10 END"


@query(f"""SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS BIGINT) AS n, CASE WHEN v IS NULL OR isnan(v) THEN 'n/a' ELSE printf('%.1f', v) || ' cm' END AS shift,
  CASE WHEN v IS NULL OR isnan(v) THEN '' WHEN v = 0 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.4f', round(v / 8, 4)), '0+$', ''), '\\.$', '') END AS number, l_returnflag || '  (' || l_linestatus || ')' AS label
  FROM (SELECT *, {_VALUES} AS v FROM lineitem)""")
def number_texts(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem", "CAST(l_orderkey AS BIGINT) AS o", "CAST(l_linenumber AS BIGINT) AS n", f"{_VALUES} AS v", "l_returnflag", "l_linestatus")
    return rows.select("o", "n", T.describe_shift("v").alias("shift"), T.number_text(F.col("v") / 8).alias("number"), planning.display_label(F.col("l_returnflag"), F.col("l_linestatus")).alias("label"))


def _hits_sql(words: list[str], mark: str) -> str:
    """All places of side words in a label, by walking over its characters."""
    kind = lambda at: f"CASE WHEN {at} < 1 OR {at} > length(label) OR substr(label, {at}, 1) IN (' ', '_', '-') THEN ' ' WHEN regexp_matches(substr(label, {at}, 1), '[a-z0-9]') THEN 'a' WHEN regexp_matches(substr(label, {at}, 1), '[A-Z]') THEN 'A' ELSE '?' END"
    lower = lambda at: f"regexp_matches(substr(label, {at}, 1), '[a-z]')"
    starts = f"({kind('i - 1')} = ' ' OR ({kind('i - 1')} = 'a' AND {kind('i')} = 'A') OR ({kind('i - 1')} = 'A' AND {lower('i')}))"
    ends = f"({kind('i + n')} = ' ' OR ({kind('i + n - 1')} = 'a' AND {kind('i + n')} = 'A'))"
    # of several words at a place the first of the list counts
    return f"""(SELECT string_agg('{mark}:''' || substr(label, i, n) || '''', ', ' ORDER BY i) FROM (SELECT i, length({words}[min(k)]) AS n FROM (SELECT unnest(range(1, length(label) + 1)) AS i) CROSS JOIN (SELECT unnest(range(1, {len(words) + 1})) AS k)
      CROSS JOIN LATERAL (SELECT length({words}[k]) AS n) WHERE lower(substr(label, i, n)) = {words}[k] AND {starts} AND {ends} GROUP BY i))"""


@query(view_sql("plan") + f""", labels AS (SELECT DISTINCT plan_id || ' ' || coalesce(site, '') AS label FROM v_plan)
SELECT label, concat_ws(', ', {_hits_sql(T.LEFT_WORDS, 'L')}, {_hits_sql(T.RIGHT_WORDS, 'R')}) AS hits FROM labels""")
def side_hits(spark, sf_dir):
    labels = view(spark, sf_dir, "plan").select(F.concat("plan_id", F.lit(" "), F.coalesce("site", F.lit(""))).alias("label")).distinct()
    return labels.select("label", T.side_hits("label").alias("hits"))


_NUMBER = lambda c: f"CASE WHEN {c} IS NULL THEN '' WHEN round({c}, 4) = 0 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.4f', round({c}, 4)), '0+$', ''), '\\.$', '') END"
_FIELD = lambda c: f"replace(coalesce({c}, ''), ';', ',')"
_LINE_METRICS = " || ';' || ".join(_NUMBER(m) for m in comparison.METRICS) + " || ';' || " + _FIELD("note")


@query(f"""SELECT patient_id, group_no || ';' || {_FIELD('match_key')} || ';' || {_FIELD('gt_set')} || ';' || {_FIELD('gt_structure')} || ';' || {_FIELD('ai_set')} || ';' || {_FIELD('ai_structure')} || ';' || {_LINE_METRICS} AS line
  FROM ({catalogue.comparison_sql("patient_id, group_no, match_key, gt_set, gt_structure, ai_set, ai_structure")})""")
def export_lines(spark, sf_dir):
    rows = catalogue.compared(spark, sf_dir, matching.auto_match(view(spark, sf_dir, "structure")).drop("gt_empty", "ai_empty")).withColumns({m: F.round(m, 6) for m in comparison.METRICS})
    return rows.select("patient_id", exports.lines(rows, exports.AUTO_COLUMNS).alias("line"))


@query(catalogue.ORACLES["q_link_groups"].replace("SELECT patient_id, dense_rank()", ", found AS (SELECT patient_id, dense_rank()") + f""")
SELECT patient_id, group_no || ';' || role || ';' || {_FIELD('set_id')} || ';' || {_FIELD('structure_id')} AS line FROM found""")
def link_export_lines(spark, sf_dir):
    nodes = view(spark, sf_dir, "node")
    edges = links.valid_edges(nodes, view(spark, sf_dir, "manual_edge")).unionByName(links.auto_links(nodes)).distinct()
    found = links.link_groups(nodes, edges, "Manual")
    return found.select("patient_id", exports.lines(found, exports.LINK_COLUMNS).alias("line"))


# --- timed jobs --------------------------------------------------------------------------------------------------

_LIMIT_S = 40 * 86400


@query(f"""WITH asked AS (SELECT CAST(o_orderkey AS VARCHAR) AS job, min(epoch(o_orderdate)) AS issued FROM orders WHERE o_orderkey % 10 > 0 GROUP BY o_orderkey),
told AS (SELECT CAST(l_orderkey AS VARCHAR) AS job, min(epoch(l_shipdate)) AS ended, list({{'c': CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 3 END}} ORDER BY l_shipdate, CASE WHEN l_suppkey % 5 = 0 THEN 9 ELSE l_suppkey % 3 END)[1].c AS code FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 > 0 GROUP BY 1),
mark AS (SELECT max(t) - 10 AS w FROM (SELECT max(issued) AS t FROM asked UNION ALL SELECT max(ended) FROM told)),
j AS (SELECT coalesce(a.job, t.job) AS job, issued, ended, code, w FROM asked a FULL JOIN told t ON t.job = a.job CROSS JOIN mark)
SELECT job, CASE WHEN issued IS NULL THEN 'unknown' WHEN ended IS NULL OR ended - issued > {_LIMIT_S} THEN 'timed out' WHEN code = 0 THEN 'done' ELSE 'failed' END AS outcome,
  CASE WHEN issued IS NULL OR ended - issued <= {_LIMIT_S} THEN CAST(code AS BIGINT) END AS exit_code,
  CASE WHEN issued IS NULL THEN NULL WHEN ended IS NULL OR ended - issued > {_LIMIT_S} THEN CAST({_LIMIT_S} AS DOUBLE) ELSE CAST(ended - issued AS DOUBLE) END AS seconds
FROM j WHERE (issued IS NOT NULL AND ended IS NOT NULL) OR coalesce(issued, ended) + {_LIMIT_S} <= w""")
def job_outcomes(spark, sf_dir):
    """Orders as commands and first lines as results, through the stream; jobs that are open at its end have no row."""
    schema = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = lambda name: spark.readStream.schema(schema(name)).parquet(f"{sf_dir}/{name}.parque[t]")
    commands = stream("orders").where("o_orderkey % 10 > 0").select(F.col("o_orderkey").cast("string").alias("job"), F.col("o_orderdate").alias("issued"))
    code = F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey") % 3).cast("int")
    results = stream("lineitem").where("l_linenumber = 1 and l_orderkey % 4 > 0").select(F.col("l_orderkey").cast("string").alias("job"), F.col("l_shipdate").alias("ended"), code.alias("exit_code"))
    to = fresh_path(spark, "jobs")
    found = timed.outcomes(commands, results, _LIMIT_S)
    found.writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(timed.OUTCOMES).parquet(f"{to}/out").withColumn("exit_code", F.col("exit_code").cast("long"))
