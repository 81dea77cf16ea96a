"""The registered queries over the domain views, and DuckDB SQL that states the same results independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoplane.checkpoints import fresh_path
from isoplane.functions import text as T
from isoplane.operators import comparison, contours, links, matching, planning, rules, search, voxels
from isoplane.sources import exports, nifti, volumes
from isoplane.sources.views import GRID, handles, tasks_of, view, view_sql

SPACING, SHAPE = GRID.spacing, GRID.size
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(fn):
        QUERIES["q_" + fn.__name__] = fn
        if sql is not None:
            ORACLES["q_" + fn.__name__] = sql
        return fn

    return put


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def _round(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# --- structure names ---------------------------------------------------------------------------------------------

_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_SIDES = _IN(T.LEFT_TOKENS + T.RIGHT_TOKENS)
_VERT = "regexp_full_match(t, '(th|c|t|l|s)[0-9]{1,2}')"
_ROLE = "CASE WHEN contains(upper(set_id), 'AUTO') THEN 'AI' ELSE 'GroundTruth' END"


def _keyed(source: str) -> str:
    """Common table expressions that end in ``keyed``: the rows of ``source`` with their organ key."""
    return f"""
k1 AS (SELECT *, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(trim(structure_id), '[\\s_./-]+', ' ', 'g'),
    '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' +'), lambda t: t <> '' AND t NOT IN {_IN(T.DROPPED_TOKENS)}) AS toks FROM {source}),
k2 AS (SELECT *, list_transform(list_filter(toks, lambda t: {_VERT}), lambda t: left(t, 1) || CAST(CAST(regexp_extract(t, '[0-9]+$') AS INTEGER) AS VARCHAR)) AS vs,
    list_filter(toks, lambda t: t IN {_SIDES}) AS ss, list_filter(toks, lambda t: NOT {_VERT} AND t NOT IN {_SIDES}) AS bs FROM k1),
keyed AS (SELECT * EXCLUDE (toks, vs, ss, bs), CASE WHEN len(vs) = 1 AND len(bs) = 0 THEN 'v:' || vs[1]
    WHEN len(bs) + len(vs) > 0 THEN array_to_string(list_concat(bs, vs), '')
      || CASE WHEN ss[1] IN {_IN(T.LEFT_TOKENS)} THEN '|L' WHEN ss[1] IN {_IN(T.RIGHT_TOKENS)} THEN '|R' ELSE '' END END AS match_key FROM k2)"""


_GATHERED = view_sql("structure") + ", gathered AS (SELECT * FROM v_structure QUALIFY row_number() OVER (PARTITION BY patient_id, set_id, structure_id ORDER BY seq DESC) = 1)"
_MEMBERS = (
    _GATHERED + "," + _keyed("gathered") + f""",
sets AS (SELECT patient_id, match_key FROM keyed WHERE match_key IS NOT NULL GROUP BY ALL HAVING count(DISTINCT set_id) >= 2),
members AS (SELECT k.*, {_ROLE} AS role, dense_rank() OVER (PARTITION BY patient_id ORDER BY upper(match_key), match_key) AS group_no,
  row_number() OVER (PARTITION BY patient_id, match_key ORDER BY CASE WHEN contains(upper(set_id), 'AUTO') THEN 1 ELSE 0 END, upper(set_id), set_id, upper(structure_id), structure_id) AS member_no
  FROM keyed k JOIN sets USING (patient_id, match_key))"""
)


@query(view_sql("structure") + "," + _keyed("v_structure") + " SELECT structure_id, match_key, lower(trim(structure_id)) AS link_key, count(*) AS n FROM keyed GROUP BY ALL")
def organ_key(spark, sf_dir):
    found = view(spark, sf_dir, "structure").groupBy("structure_id").agg(F.count("*").alias("n"))
    return found.select("structure_id", T.organ_key("structure_id").alias("match_key"), T.link_key("structure_id").alias("link_key"), "n")


@query(_MEMBERS + " SELECT patient_id, group_no, member_no, match_key, role, set_id, structure_id, is_empty FROM members")
def auto_match_members(spark, sf_dir):
    found = matching.match_groups(matching.gather(view(spark, sf_dir, "structure")))
    return found.select("patient_id", *_long("group_no", "member_no"), "match_key", "role", "set_id", "structure_id", "is_empty")


_PAIRS = _MEMBERS + """,
pairs AS (SELECT a.patient_id, a.group_no, a.match_key, g.set_id AS gt_set, g.structure_id AS gt_structure, a.set_id AS ai_set, a.structure_id AS ai_structure,
  CASE WHEN g.set_id IS NULL THEN 'no ground-truth structure in this group' END AS note
  FROM (SELECT * FROM members WHERE role = 'AI') a
  LEFT JOIN (SELECT * FROM members WHERE role = 'GroundTruth' AND member_no = 1) g ON a.patient_id = g.patient_id AND a.match_key = g.match_key)"""


@query(_PAIRS + " SELECT * FROM pairs")
def auto_match(spark, sf_dir):
    found = matching.auto_match(view(spark, sf_dir, "structure"))
    return found.select("patient_id", *_long("group_no"), "match_key", "gt_set", "gt_structure", "ai_set", "ai_structure", "note")


@query(view_sql("structure") + f""" SELECT patient_id, count(DISTINCT CASE WHEN r = 'GroundTruth' THEN set_id END) AS n_sets,
  coalesce(string_agg(DISTINCT CASE WHEN r = 'GroundTruth' THEN set_id END, ', ' ORDER BY CASE WHEN r = 'GroundTruth' THEN set_id END), '') AS sets,
  CASE count(DISTINCT CASE WHEN r = 'GroundTruth' THEN set_id END) WHEN 0 THEN 'none' WHEN 1 THEN '' ELSE 'several' END AS warning
  FROM (SELECT *, {_ROLE} AS r FROM v_structure) GROUP BY patient_id""")  # fmt: skip
def gt_warning(spark, sf_dir):
    return matching.ground_truth_warning(view(spark, sf_dir, "structure")).select("patient_id", *_long("n_sets"), "sets", "warning")


def _pair_sql(extra: str) -> str:
    return _GATHERED + "," + _keyed("gathered") + f""",
one AS (SELECT * FROM keyed WHERE match_key IS NOT NULL AND set_id IN ('Manual', 'TotalSegAuto') {extra}
  QUALIFY row_number() OVER (PARTITION BY patient_id, set_id, match_key ORDER BY upper(structure_id), structure_id) = 1)
SELECT g.patient_id, g.match_key, g.structure_id AS gt_structure, c.structure_id AS cmp_structure FROM one g JOIN one c USING (patient_id, match_key)
WHERE g.set_id = 'Manual' AND c.set_id = 'TotalSegAuto'"""


@query(_pair_sql(""))
def pair_match(spark, sf_dir):
    return matching.pair_match(view(spark, sf_dir, "structure"), "Manual", "TotalSegAuto")


@query(_pair_sql("AND upper(trim(structure_id)) <> 'BODY'"))
def pair_match_nobody(spark, sf_dir):
    return matching.pair_match(view(spark, sf_dir, "structure"), "Manual", "TotalSegAuto", skip_body=True)


@query(view_sql("structure") + """ SELECT a.seq, CASE WHEN b.seq IS NULL THEN 'structure handle missing' WHEN a.nx % 13 = 0 THEN 'ground-truth set has no image to rasterize on'
  WHEN a.frame IS NULL OR b.frame IS NULL OR a.frame <> b.frame THEN 'ground truth and AI are in different frames of reference' WHEN a.nx % 7 = 0 THEN 'empty structure (no segment)' WHEN a.nx % 11 = 0 THEN 'no mesh geometry / bounds unavailable'
  WHEN a.nx - 2 <= 0 THEN 'degenerate bounding box' WHEN a.nx * a.nx * 20000 > 25000000 THEN 'structure too large (' || format('{:,}', a.nx * a.nx * 20000) || ' voxels)' WHEN a.is_empty OR b.is_empty THEN 'empty structure (no voxels)' END AS note
  FROM v_structure a LEFT JOIN v_structure b ON b.seq = a.seq + 3""")  # fmt: skip
def eligibility_notes(spark, sf_dir):
    a = view(spark, sf_dir, "structure")
    b = a.select((F.col("seq") - 3).alias("seq"), F.col("frame").alias("other_frame"), F.col("is_empty").alias("other_empty"), F.lit(True).alias("found"))
    met = a.join(b, "seq", "left")
    nx = F.col("nx")
    note = matching.eligibility_note(
        F.coalesce("found", F.lit(False)), nx % 13 != 0, F.col("frame"), F.col("other_frame"), nx % 7 != 0, nx % 11 != 0,
        F.when(nx > 2, nx * nx * 20000).otherwise(0), ~(F.col("is_empty") | F.col("other_empty")),
    )
    return met.select("seq", note.alias("note"))


# --- masks -------------------------------------------------------------------------------------------------------

_SX, _SY, _SZ = SPACING
_XYZ = "image, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z"
_BORDER = view_sql("mask") + """, steps(dx, dy, dz) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
edge AS (SELECT DISTINCT m.pair_id, m.role, m.x, m.y, m.z FROM v_mask m CROSS JOIN steps s
  LEFT JOIN v_mask n ON n.pair_id = m.pair_id AND n.role = m.role AND n.x = m.x + dx AND n.y = m.y + dy AND n.z = m.z + dz WHERE n.x IS NULL)"""
_DIRECTED = _BORDER + f""",
dist AS (SELECT a.pair_id, a.role, a.x, a.y, a.z, sqrt(min(((a.x - b.x) * {_SX}) ** 2 + ((a.y - b.y) * {_SY}) ** 2 + ((a.z - b.z) * {_SZ}) ** 2)) AS d
  FROM edge a JOIN edge b ON a.pair_id = b.pair_id AND a.role <> b.role GROUP BY ALL)"""  # fmt: skip


def _overlap_sql(name: str) -> str:
    return view_sql(name) + f""", bo AS (SELECT pair_id, x, y, z, max(CASE WHEN role = 'GT' THEN 1 ELSE 0 END) AS g, max(CASE WHEN role = 'AI' THEN 1 ELSE 0 END) AS a FROM v_{name} GROUP BY ALL),
s AS (SELECT pair_id, CAST(sum(g) AS BIGINT) AS cg, CAST(sum(a) AS BIGINT) AS ca, sum(g * a) AS i, count(*) AS u,
  avg(x) FILTER (g = 1) AS gx, avg(y) FILTER (g = 1) AS gy, avg(z) FILTER (g = 1) AS gz, avg(x) FILTER (a = 1) AS ax, avg(y) FILTER (a = 1) AS ay, avg(z) FILTER (a = 1) AS az FROM bo GROUP BY pair_id)
SELECT pair_id, cg, ca, CASE WHEN ok THEN round(2.0 * i / (cg + ca), 6) END AS dice, CASE WHEN ok THEN round(CAST(i AS DOUBLE) / u, 6) END AS jaccard,
  CASE WHEN ok THEN round(cg * CAST({_SX * _SY * _SZ / 1000} AS DOUBLE), 6) END AS volume_gt_cc, CASE WHEN ok THEN round(ca * CAST({_SX * _SY * _SZ / 1000} AS DOUBLE), 6) END AS volume_ai_cc,
  CASE WHEN ok THEN round((ca - cg) * CAST({_SX * _SY * _SZ / 1000} AS DOUBLE), 6) END AS volume_diff_cc,
  CASE WHEN ok THEN round(sqrt(((ax - gx) * {_SX}) ** 2 + ((ay - gy) * {_SY}) ** 2 + ((az - gz) * {_SZ}) ** 2), 6) END AS com_diff_mm,
  CASE WHEN NOT ok THEN 'empty structure (no voxels)' END AS note FROM (SELECT *, cg > 0 AND ca > 0 AS ok FROM s)"""


@query(_overlap_sql("mask"))
def overlap(spark, sf_dir):
    found = voxels.overlap(view(spark, sf_dir, "mask"), ["pair_id"], SPACING)
    return found.select("pair_id", *_long("cg", "ca"), *_round("dice", "jaccard", "volume_gt_cc", "volume_ai_cc", "volume_diff_cc", "com_diff_mm"), "note")


@query(_overlap_sql("mask_noise"))
def overlap_noise(spark, sf_dir):
    found = voxels.overlap(view(spark, sf_dir, "mask_noise"), ["pair_id"], SPACING)
    return found.select("pair_id", *_long("cg", "ca"), *_round("dice", "jaccard", "volume_gt_cc", "volume_ai_cc", "volume_diff_cc", "com_diff_mm"), "note")


def _fill_sql(source: str, key: str) -> str:
    """Tables up to ``filled``: the pixels of the contours in ``source``, rows sampled half a pixel below their own line."""
    near = lambda x: f"CAST(floor(({x} + 32768) / 65536.0) AS BIGINT)"
    return f"""corner AS (SELECT {key}, contour_no, vertex_no, CAST(round_even(px, 0) AS BIGINT) AS x, CAST(round_even(py, 0) AS BIGINT) AS y, count(*) OVER (PARTITION BY {key}, contour_no) AS n FROM {source}),
edge2 AS (SELECT {key}, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM corner WHERE n >= 3 WINDOW w AS (PARTITION BY {key}, contour_no ORDER BY vertex_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
east AS (SELECT {key}, least(x1, x2) AS x, CASE WHEN x1 <= x2 THEN y1 ELSE y2 END AS y, abs(x2 - x1) AS dx, CASE WHEN x1 <= x2 THEN y2 - y1 ELSE y1 - y2 END AS rise FROM edge2),
drawn AS (SELECT {key}, CASE WHEN dx >= abs(rise) THEN x + k ELSE x + CAST(ceil(k * dx / CAST(abs(rise) AS DOUBLE) - 0.5) AS BIGINT) END AS x,
  CASE WHEN dx < abs(rise) THEN y + k * sign(rise) WHEN dx = 0 THEN y ELSE y + sign(rise) * CAST(ceil(k * abs(rise) / CAST(dx AS DOUBLE) - 0.5) AS BIGINT) END AS y FROM (SELECT *, unnest(range(greatest(dx, abs(rise)) + 1)) AS k FROM east)),
line AS (SELECT unnest(range(-5, 60)) AS y), sloped AS (SELECT {key}, CASE WHEN y1 < y2 THEN x1 ELSE x2 END AS xa, least(y1, y2) AS ya, CASE WHEN y1 < y2 THEN x2 ELSE x1 END AS xb, greatest(y1, y2) AS yb FROM edge2 WHERE y1 <> y2),
crossing AS (SELECT {key}, line.y, xa * 65536 + CAST(trunc((xb - xa) * 65536 / CAST(yb - ya AS DOUBLE)) AS BIGINT) * (line.y - ya) AS x FROM sloped JOIN line ON line.y + 0.5 BETWEEN ya AND yb),
span AS (SELECT {key}, y, x, lead(x) OVER w AS to_x, row_number() OVER w AS no FROM crossing WINDOW w AS (PARTITION BY {key}, y ORDER BY x)),
filled AS (SELECT {key}, x, CAST(y AS BIGINT) AS y FROM drawn UNION SELECT {key}, unnest(range({near('x')}, {near('to_x')} + 1)), y FROM span WHERE no % 2 = 1)"""


@query(view_sql("contour") + "," + _fill_sql("v_contour", "pair_id") + " SELECT pair_id, CAST(x AS BIGINT) AS x, y FROM filled")
def polygon_fill(spark, sf_dir):
    return contours.fill(view(spark, sf_dir, "contour"), ["pair_id"]).select("pair_id", *_long("x", "y"))


@query(view_sql("contour", "mask") + ", drawn_on AS (SELECT *, contour_no AS z FROM v_contour)," + _fill_sql("drawn_on", "pair_id, z") + """
SELECT pair_id, role, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM v_mask m WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.pair_id = m.pair_id AND f.z = m.z AND f.x = m.x AND f.y = m.y)""")
def polygon_erase(spark, sf_dir):
    points = view(spark, sf_dir, "contour").withColumn("z", F.col("contour_no").cast("int"))
    return contours.erase(view(spark, sf_dir, "mask"), points, ["pair_id"]).select("pair_id", "role", *_long("x", "y", "z"))


@query(view_sql("mask") + """ SELECT pair_id, role, """ + ", ".join(f"CAST({f}({c}) AS BIGINT) AS {c}{k}" for c in "xyz" for k, f in ((0, "min"), (1, "max"))) + """, count(*) AS voxels,
  round(count(*) * CAST(0.0045 AS DOUBLE), 6) AS volume_cc, max(CASE WHEN x = 2 AND z = 0 THEN CAST(y AS BIGINT) END) AS surface FROM v_mask GROUP BY pair_id, role""")
def mask_report(spark, sf_dir):
    mask = view(spark, sf_dir, "mask")
    ray = voxels.surface_on_ray(mask, ["pair_id", "role"], 2, 0, 0)
    found = voxels.bounds_report(mask, ["pair_id", "role"], SPACING).join(ray, ["pair_id", "role"], "left")
    return found.select("pair_id", "role", *_long("x0", "x1", "y0", "y1", "z0", "z1", "voxels"), *_round("volume_cc"), *_long("surface"))


@query(view_sql("hu") + f""", m AS (SELECT * FROM v_hu WHERE raw >= 400)
SELECT {_XYZ} FROM m WHERE (SELECT count(*) FROM m n WHERE n.image = m.image AND n.z = m.z AND abs(n.x - m.x) + abs(n.y - m.y) = 1) < 4""")  # fmt: skip
def outline(spark, sf_dir):
    return voxels.outline(_hu(spark, sf_dir, 400), ["image"]).select("image", *_long("x", "y", "z"))


@query()
def contours_nested(spark, sf_dir):
    found = contours.trace(_hu(spark, sf_dir, 400), ["image"], nested=True)
    return found.select("image", *_long("z", "contour_no", "parent"), "is_hole", F.to_json("vertices").alias("vertices"))


@query(view_sql("hu") + f" SELECT {_XYZ} FROM v_hu WHERE raw >= 400")
def contours_filled(spark, sf_dir):
    """Contours with their holes, filled again: the mask itself."""
    traced = contours.points_of(contours.trace(_hu(spark, sf_dir, 400), ["image"], nested=True), ["image"]).repartition(tasks_of(spark, sf_dir, "hu"), "image")
    return contours.fill(traced, ["image", "z"], least=1).select("image", *_long("x", "y", "z"))


@query(view_sql("hu").replace("WITH", "WITH RECURSIVE", 1) + f""", m AS (SELECT * FROM v_hu WHERE raw >= 1200), slice AS (SELECT DISTINCT image, z FROM m),
free AS (SELECT image, z, x, y FROM slice CROSS JOIN (SELECT unnest(range(-1, 17)) AS x) CROSS JOIN (SELECT unnest(range(-1, 17)) AS y) ANTI JOIN m USING (image, z, x, y)),
air AS (SELECT image, z, x, y FROM free WHERE x = -1 AND y = -1 UNION SELECT f.image, f.z, f.x, f.y FROM air a JOIN free f ON f.image = a.image AND f.z = a.z AND abs(f.x - a.x) + abs(f.y - a.y) = 1)
SELECT {_XYZ} FROM (SELECT image, z, x, y FROM slice CROSS JOIN (SELECT unnest(range(16)) AS x) CROSS JOIN (SELECT unnest(range(16)) AS y)) ANTI JOIN air USING (image, z, x, y)""")
def contours_solid(spark, sf_dir):
    """Outermost contours, filled: the mask without its holes."""
    traced = contours.points_of(contours.trace(_hu(spark, sf_dir, 1200), ["image"]), ["image"]).repartition(tasks_of(spark, sf_dir, "hu"), "image")
    return contours.fill(traced, ["image", "z"], least=1).select("image", *_long("x", "y", "z"))


@query(_BORDER + " SELECT pair_id, role, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM edge")
def border(spark, sf_dir):
    return voxels.border(view(spark, sf_dir, "mask"), ["pair_id", "role"]).select("pair_id", "role", *_long("x", "y", "z"))


@query(_DIRECTED + " SELECT pair_id, role, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z, round(d, 6) AS d FROM dist")
def directed_dist(spark, sf_dir):
    return voxels.directed_distances(view(spark, sf_dir, "mask"), ["pair_id"], SPACING).select("pair_id", "role", *_long("x", "y", "z"), *_round("d"))


@query(_DIRECTED + """ SELECT pair_id, round(max(d), 6) AS hausdorff_mm, round(quantile_cont(d, 0.95), 6) AS hd95_mm,
  round((avg(d) FILTER (role = 'GT') + avg(d) FILTER (role = 'AI')) / 2, 6) AS assd_mm FROM dist GROUP BY pair_id""")  # fmt: skip
def surface_metrics(spark, sf_dir):
    return voxels.surface_metrics(view(spark, sf_dir, "mask"), ["pair_id"], SPACING).select("pair_id", *_round("hausdorff_mm", "hd95_mm", "assd_mm"))


def _compare_sql(pairs: str, columns: str) -> str:
    """SQL that ends in the comparison of the rows of ``pairs``, stated with the parts of the queries above."""
    length = lambda c, n: f"(least({n - 1}, greatest(g.{c}1, a.{c}1) + 1) - greatest(0, least(g.{c}0, a.{c}0) - 1) + 1)"
    box = " * ".join(length(c, n) for c, n in zip("xyz", SHAPE))
    overlap = _overlap_sql("mask").removeprefix(view_sql("mask"))
    ctes, last = overlap.split("\nSELECT pair_id, cg", 1)
    return f"""{pairs},{view_sql("structure_mask").removeprefix("WITH")},
hand AS (SELECT patient_id, set_id, structure_id, seq, frame, nx, seq % 3 AS x0, seq % 3 + 1 + nx % 3 AS x1, seq % 2 AS y0, seq % 2 + 1 + nx % 2 AS y1, 0 AS z0, nx % 3 AS z1 FROM gathered),
why AS (SELECT p.* EXCLUDE (note), g.seq * 1000000000 + a.seq AS pair_id, g.seq AS gs, a.seq AS s2, CASE WHEN p.note IS NOT NULL THEN p.note WHEN g.nx % 13 = 0 THEN 'ground-truth set has no image to rasterize on'
  WHEN g.frame IS NULL OR a.frame IS NULL OR g.frame <> a.frame THEN 'ground truth and AI are in different frames of reference' WHEN g.nx % 7 = 0 OR a.nx % 7 = 0 THEN 'empty structure (no segment)'
  WHEN g.nx % 11 = 0 OR a.nx % 11 = 0 OR g.nx % 17 = 0 OR a.nx % 17 = 0 THEN 'no mesh geometry / bounds unavailable' WHEN {box} > {_CAP} THEN 'structure too large (' || {box} || ' voxels)' END AS note
  FROM pairs p LEFT JOIN hand g ON g.patient_id = p.patient_id AND g.set_id = p.gt_set AND g.structure_id = p.gt_structure
  LEFT JOIN hand a ON a.patient_id = p.patient_id AND a.set_id = p.ai_set AND a.structure_id = p.ai_structure),
v_mask AS (SELECT DISTINCT pair_id, 'GT' AS role, x, y, z FROM why JOIN v_structure_mask ON handle = gs WHERE note IS NULL
  UNION ALL SELECT DISTINCT pair_id, 'AI', x, y, z FROM why JOIN v_structure_mask ON handle = s2 WHERE note IS NULL)
{ctes}, measured AS (SELECT pair_id, cg{last}){_DIRECTED.removeprefix(view_sql("mask"))},
surface AS (SELECT pair_id, round(max(d), 6) AS hausdorff_mm, round(quantile_cont(d, 0.95), 6) AS hd95_mm, round((avg(d) FILTER (role = 'GT') + avg(d) FILTER (role = 'AI')) / 2, 6) AS assd_mm FROM dist GROUP BY pair_id)
SELECT {columns}, dice, jaccard, hausdorff_mm, hd95_mm, assd_mm, volume_gt_cc, volume_ai_cc, volume_diff_cc, com_diff_mm,
  CASE WHEN w.note IS NOT NULL THEN w.note WHEN dice IS NULL THEN 'empty structure (no voxels)' END AS note FROM why w LEFT JOIN measured USING (pair_id) LEFT JOIN surface USING (pair_id)"""


#: A cap small enough for the views to meet it.
_CAP = 150


def comparison_sql(columns: str) -> str:
    """SQL of the measured comparison of all automatic structures."""
    return _compare_sql(_PAIRS, columns)


def compared(spark, sf_dir, rows):
    """The measured comparison of the views' structures."""
    return comparison.compare(rows, handles(spark, sf_dir), view(spark, sf_dir, "structure_mask"), GRID, _CAP)


@query(_compare_sql(_PAIRS, "patient_id, group_no, match_key, gt_set, gt_structure, ai_set, ai_structure"))
def comparison_rows(spark, sf_dir):
    found = compared(spark, sf_dir, matching.auto_match(view(spark, sf_dir, "structure")).drop("gt_empty", "ai_empty"))
    return found.select("patient_id", *_long("group_no"), "match_key", "gt_set", "gt_structure", "ai_set", "ai_structure", *_round(*comparison.METRICS), "note")


_SHOWN = lambda c: f"CASE WHEN {c} IS NULL THEN 'n/a' ELSE regexp_replace(regexp_replace(printf('%.3f', {c}), '0+$', ''), '\\.$', '') END"


@query(f"""WITH c AS ({comparison_sql("patient_id, group_no, match_key, gt_set, gt_structure, ai_set, ai_structure")})
SELECT patient_id, group_no, '[' || group_no || '] ' || match_key || chr(10) || string_agg('     GT ' || CASE WHEN coalesce(gt_structure, '') = '' THEN '(no GT)' ELSE gt_set || ':' || gt_structure END || '   vs   AI ' || ai_set || ':' || ai_structure || chr(10) ||
  CASE WHEN note IS NULL THEN '        DICE ' || {_SHOWN('dice')} || '  Jaccard ' || {_SHOWN('jaccard')} || '  HD ' || {_SHOWN('hausdorff_mm')} || 'mm  HD95 ' || {_SHOWN('hd95_mm')} || 'mm  ASSD ' || {_SHOWN('assd_mm')} || 'mm' || chr(10) ||
    '        Vol GT/AI ' || {_SHOWN('volume_gt_cc')} || '/' || {_SHOWN('volume_ai_cc')} || ' cc  (diff ' || {_SHOWN('volume_diff_cc')} || ' cc)  COM diff ' || {_SHOWN('com_diff_mm')} || ' mm'
  ELSE '        — ' || note END, chr(10) ORDER BY upper(ai_set), ai_set, upper(ai_structure), ai_structure) AS report FROM c GROUP BY patient_id, group_no, match_key""")
def match_report(spark, sf_dir):
    rows = matching.auto_match(view(spark, sf_dir, "structure")).drop("gt_empty", "ai_empty")
    measured = compared(spark, sf_dir, rows).withColumns({m: F.round(m, 6) for m in comparison.METRICS})
    return exports.report(measured).select("patient_id", *_long("group_no"), "report")


_PICKED = _pair_sql("").replace("SELECT g.patient_id", ", pairs AS (SELECT 'Manual' AS gt_set, 'TotalSegAuto' AS ai_set, NULL AS note, g.patient_id").replace("AS cmp_structure", "AS ai_structure") + ")"


@query(_compare_sql(_PICKED, "patient_id, match_key, gt_structure, ai_structure"))
def pair_comparison(spark, sf_dir):
    rows = matching.pair_match(view(spark, sf_dir, "structure"), "Manual", "TotalSegAuto").withColumnRenamed("cmp_structure", "ai_structure")
    rows = rows.withColumns({"gt_set": F.lit("Manual"), "ai_set": F.lit("TotalSegAuto"), "note": F.lit(None).cast("string")})
    return compared(spark, sf_dir, rows).select("patient_id", "match_key", "gt_structure", "ai_structure", *_round(*comparison.METRICS), "note")


_BOX = [("x", 9), ("y", 9), ("z", 4)]


@query(view_sql("mask") + " SELECT pair_id, " + ", ".join(
    f"CAST(greatest(floor(min({c} * 0.75 + 0.1)) - 1, 0) AS BIGINT) AS {c}0, CAST(least(ceil(max({c} * 0.75 + 0.1)) + 1, {n - 1}) AS BIGINT) AS {c}1" for c, n in _BOX
) + " FROM v_mask GROUP BY pair_id")
def index_box(spark, sf_dir):
    points = view(spark, sf_dir, "mask").select("pair_id", *[(F.col(c) * 0.75 + 0.1).alias(f"p{c}") for c in "xyz"])
    found = voxels.index_box(points, ["pair_id"], tuple(n for _, n in _BOX))
    return found.select("pair_id", *_long(*[f"{c}{k}" for c in "xyz" for k in (0, 1)]))


#: A grid turned in its plane.
_TURNED = voxels.Grid((-3.5, 2.25, -10.0), ((0.8, 0.6, 0.0), (-0.6, 0.8, 0.0), (0.0, 0.0, 1.0)), (1.0, 1.5, 3.0), (40, 30, 20))
_MM = {"lx": "p_size * 1.25 - 20", "ly": "p_partkey % 60 - 15.5", "lz": "p_partkey % 90 - 30", "sx": "p_size % 7 + 0.3", "sy": "p_partkey % 11", "sz": "p_size % 5 * 2.5"}


def _turned_sql() -> str:
    place = lambda d: " + ".join(f"({v} - CAST({o} AS DOUBLE)) * CAST({c} AS DOUBLE)" for v, o, c in zip("XYZ", _TURNED.origin, d))
    at = ", ".join(f"(CAST(0.0 AS DOUBLE) + {place(d)}) / CAST({s} AS DOUBLE) AS p{n}" for n, d, s in zip("xyz", _TURNED.directions, _TURNED.spacing))
    sides = ", ".join(f"greatest(0, CAST(floor(min(p{n})) AS BIGINT)) AS {n}0, least({k - 1}, CAST(ceil(max(p{n})) AS BIGINT)) AS {n}1" for n, k in zip("xyz", _TURNED.size))
    inside = " AND ".join(f"{n}1 >= {n}0" for n in "xyz")
    return f"""WITH box AS (SELECT p_partkey, {", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _MM.items())} FROM part),
c AS (SELECT p_partkey, lx + i * sx AS X, ly + j * sy AS Y, lz + k * sz AS Z FROM box CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j) CROSS JOIN (VALUES (0), (1)) d(k)),
p AS (SELECT p_partkey, {at} FROM c), s AS (SELECT p_partkey, {sides} FROM p GROUP BY p_partkey)
SELECT CAST(p_partkey AS BIGINT) AS structure, {", ".join(f"CASE WHEN {inside} THEN {n}{k} END AS {n}{k}" for n in "xyz" for k in (0, 1))} FROM s"""


@query(_turned_sql())
def oriented_box(spark, sf_dir):
    boxes = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *[F.expr(e).cast("double").alias(n) for n, e in _MM.items()])
    sides, inside = voxels.oriented_box([F.col(c) for c in ("lx", "ly", "lz")], [F.col(c) for c in ("sx", "sy", "sz")], _TURNED)
    return boxes.select(F.col("p_partkey").cast("long").alias("structure"), *[F.when(inside, v).alias(n) for n, v in sides.items()])


@query(view_sql("mask") + """ SELECT pair_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z,
  CASE WHEN count(DISTINCT role) = 2 THEN 'both' ELSE max(role) END AS part FROM v_mask GROUP BY pair_id, x, y, z""")  # fmt: skip
def mask_set_operations(spark, sf_dir):
    mask, spot = view(spark, sf_dir, "mask"), ["pair_id", "x", "y", "z"]
    gt, ai = (mask.where(F.col("role") == r).select(*spot) for r in ("GT", "AI"))
    either = voxels.union(gt, ai)
    only = lambda a, b, name: voxels.subtract(a, b, ["pair_id"]).withColumn("part", F.lit(name))
    alone = only(gt, ai, "GT").unionByName(only(ai, gt, "AI"))
    both = voxels.subtract(either, alone, ["pair_id"]).withColumn("part", F.lit("both"))
    return alone.unionByName(both).select("pair_id", *_long("x", "y", "z"), "part")


# --- voxel volumes -----------------------------------------------------------------------------------------------



def _hu(spark, sf_dir, least: int = 0):
    return view(spark, sf_dir, "hu").where(F.col("raw") >= least)


@query(view_sql("hu") + f" SELECT {_XYZ}, CAST(raw AS BIGINT) AS raw FROM v_hu WHERE CASE WHEN image % 2 = 1 THEN raw <= 474 ELSE raw >= 474 END")
def threshold(spark, sf_dir):
    # -550 HU at slope 1 (or -1 on odd images) and intercept -1024 (or -76)
    odd = F.col("image") % 2 == 1
    slope, intercept = F.when(odd, -1.0).otherwise(1.0), F.when(odd, -76.0).otherwise(-1024.0)
    found = voxels.threshold(_hu(spark, sf_dir), voxels.raw_limit(-550, slope, intercept), odd)
    return found.select("image", *_long("x", "y", "z", "raw"))


@query(view_sql("hu") + f""", m AS (SELECT * FROM v_hu WHERE raw >= 1200), d AS (SELECT image, x, y, s.v AS z, bool_or(m.z = s.v) AS f
  FROM m CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) s(v) WHERE m.z BETWEEN 1 AND 6 GROUP BY ALL),
g AS (SELECT *, max(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY image, x, y ORDER BY z ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM d),
e AS (SELECT *, min(v) OVER (PARTITION BY image, x, y ORDER BY z ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS w FROM g)
SELECT {_XYZ} FROM (SELECT image, x, y, z FROM e WHERE w = 1 UNION SELECT image, x, y, z FROM m)""")  # fmt: skip
def close_z(spark, sf_dir):
    return voxels.close_z(_hu(spark, sf_dir, 1200), ["image"], 1, 1, 6).select("image", *_long("x", "y", "z"))


_KERNEL = "(VALUES " + ", ".join(f"({dx}, {dy})" for dy, half in ((-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0)) for dx in range(-half, half + 1)) + ") k(dx, dy)"


_CLOSED = f"""g AS (SELECT DISTINCT image, z, x + dx AS x, y + dy AS y FROM m CROSS JOIN {_KERNEL} WHERE x + dx BETWEEN 0 AND 15 AND y + dy BETWEEN 0 AND 15),
closed AS (SELECT c.image, c.z, c.x, c.y FROM g c CROSS JOIN {_KERNEL} LEFT JOIN g n ON n.image = c.image AND n.z = c.z AND n.x = c.x + dx AND n.y = c.y + dy
  WHERE c.x + dx BETWEEN 0 AND 15 AND c.y + dy BETWEEN 0 AND 15 GROUP BY ALL HAVING count(*) = count(n.x))"""


@query(view_sql("hu") + f""", m AS (SELECT * FROM v_hu WHERE raw >= 1500), {_CLOSED} SELECT {_XYZ} FROM closed""")
def close_2d(spark, sf_dir):
    return voxels.close_2d(_hu(spark, sf_dir, 1500), ["image"], 2, *SHAPE[:2]).select("image", *_long("x", "y", "z"))


@query(view_sql("hu") + f""", s AS (SELECT v FROM (VALUES (-2), (-1), (0), (1), (2)) s(v))
SELECT DISTINCT image, CAST(x + a.v AS BIGINT) AS x, CAST(y + b.v AS BIGINT) AS y, CAST(z + c.v AS BIGINT) AS z FROM v_hu CROSS JOIN s a CROSS JOIN s b CROSS JOIN s c
WHERE raw >= 1800 AND (a.v * {_SX}) ** 2 + (b.v * {_SY}) ** 2 + (c.v * {_SZ}) ** 2 <= 4.000000001""")  # fmt: skip
def margin_grow(spark, sf_dir):
    return voxels.grow(_hu(spark, sf_dir, 1800), ["image"], 2.0, SPACING).select("image", *_long("x", "y", "z"))


@query(view_sql("hu") + f""", m AS (SELECT * FROM v_hu WHERE raw >= 300)
SELECT {_XYZ} FROM m WHERE (SELECT count(*) FROM m n WHERE n.image = m.image AND (m.z = n.z AND (abs(m.x - n.x) + abs(m.y - n.y) <= 1))) = 5""")  # fmt: skip
def margin_shrink(spark, sf_dir):
    return voxels.shrink(_hu(spark, sf_dir, 300), ["image"], 1.5, (1.5, 1.5, 3.0)).select("image", *_long("x", "y", "z"))


@query(view_sql("hu") + f""", m AS (SELECT * FROM v_hu WHERE raw < 1500), b AS (SELECT image, z, x, max(y) AS b FROM v_hu WHERE raw >= 1900 GROUP BY ALL),
c AS (SELECT i.image, i.z, s.x, b.b FROM (SELECT DISTINCT image, z FROM b) i CROSS JOIN (SELECT unnest(range(16)) AS x) s LEFT JOIN b ON b.image = i.image AND b.z = i.z AND b.x = s.x),
f AS (SELECT *, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY image, z ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(b IGNORE NULLS) OVER (PARTITION BY image, z ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS cut FROM c)
SELECT m.image, CAST(m.x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(m.z AS BIGINT) AS z FROM m JOIN f ON f.image = m.image AND f.z = m.z AND f.x = m.x WHERE y > cut""")  # fmt: skip
def fill_below(spark, sf_dir):
    hu = _hu(spark, sf_dir)
    found = voxels.keep_below(hu.where("raw < 1500"), hu.where("raw >= 1900"), ["image"], SHAPE[0])
    return found.select("image", *_long("x", "y", "z"))


_COMPONENTS = view_sql("hu").replace("WITH", "WITH RECURSIVE", 1) + """, m AS (SELECT image, x, y, z, CAST(x + 16 * (y + 16 * z) AS BIGINT) AS i FROM v_hu WHERE raw >= 1900),
e AS (SELECT a.image, a.i AS a, b.i AS b FROM m a JOIN m b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
r AS (SELECT image, a, b FROM e UNION SELECT r.image, r.a, e.b FROM r JOIN e ON e.image = r.image AND e.a = r.b),
l AS (SELECT image, a AS i, min(b) AS label FROM r GROUP BY ALL), c AS (SELECT m.*, label FROM m JOIN l USING (image, i)),
n AS (SELECT image, label, count(*) AS size FROM c GROUP BY ALL)"""


def _labelled(spark, sf_dir):
    return voxels.label_components(_hu(spark, sf_dir, 1900), ["image"], *SHAPE[:2])


@query(_COMPONENTS + f" SELECT {_XYZ}, label FROM c JOIN n USING (image, label) WHERE size >= 3")
def components(spark, sf_dir):
    return voxels.drop_small(_labelled(spark, sf_dir), ["image"], 3).select("image", *_long("x", "y", "z", "label"))


@query(_COMPONENTS + """ SELECT image, label, count(*) AS n, CAST(min(z) AS BIGINT) AS z0, CAST(max(z) AS BIGINT) AS z1
  FROM c JOIN (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY image ORDER BY size DESC, label) = 1) USING (image, label) GROUP BY ALL""")  # fmt: skip
def largest_component(spark, sf_dir):
    found = voxels.keep_largest(_labelled(spark, sf_dir), ["image"])
    return found.groupBy("image", "label").agg(F.count("*").alias("n"), F.min("z").cast("long").alias("z0"), F.max("z").cast("long").alias("z1"))


def _labels_sql(mask: str, name: str) -> str:
    """Tables up to ``{name}``: the voxels of ``mask`` with their component's label and size, by spreading from each voxel."""
    return f"""{name}_i AS (SELECT image, x, y, z, x + 16 * (y + 16 * z) AS i FROM {mask}),
{name}_e AS (SELECT a.image, a.i AS a, b.i AS b FROM {name}_i a JOIN {name}_i b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
{name}_r AS (SELECT image, a, b FROM {name}_e UNION SELECT r.image, r.a, e.b FROM {name}_r r JOIN {name}_e e ON e.image = r.image AND e.a = r.b),
{name} AS (SELECT i.image, x, y, z, label, count(*) OVER (PARTITION BY i.image, label) AS size FROM {name}_i i JOIN (SELECT image, a, min(b) AS label FROM {name}_r GROUP BY ALL) l ON l.image = i.image AND l.a = i.i)"""


def _closing_sql(mask: str, radius: int, name: str) -> str:
    """Tables up to ``{name}``: the closing of ``mask``, by counting set pixels in each row of the kernel with running sums."""
    rows = ", ".join(f"({dy}, {max(x for x, y in voxels.ellipse(radius) if y == dy)})" for dy in range(-radius, radius + 1))

    def within(sums: str, out: str, test: str) -> str:
        count = "coalesce(hi.c, 0) - coalesce(lo.c, 0)"
        return f"""{out} AS (SELECT p.image, p.z, p.x, p.y FROM {name}_p p CROSS JOIN (VALUES {rows}) k(dy, half)
  LEFT JOIN {sums} hi ON hi.image = p.image AND hi.z = p.z AND hi.y = p.y + dy AND hi.x = least(15, p.x + half) LEFT JOIN {sums} lo ON lo.image = p.image AND lo.z = p.z AND lo.y = p.y + dy AND lo.x = greatest(0, p.x - half) - 1
  WHERE p.y + dy BETWEEN 0 AND 15 GROUP BY ALL HAVING {test.replace('@', count)})"""

    sums = lambda of: f"SELECT p.image, p.z, p.x, p.y, sum(CASE WHEN m.x IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.image, p.z, p.y ORDER BY p.x) AS c FROM {name}_p p LEFT JOIN {of} m ON m.image = p.image AND m.z = p.z AND m.x = p.x AND m.y = p.y"
    return f"""{name}_p AS (SELECT image, z, x, y FROM (SELECT DISTINCT image, z FROM {mask}) CROSS JOIN (SELECT unnest(range(16)) AS x) CROSS JOIN (SELECT unnest(range(16)) AS y)),
{name}_s AS ({sums(mask)}), {within(f"{name}_s", f"{name}_g", "max(@) > 0")},
{name}_t AS ({sums(f"{name}_g")}), {within(f"{name}_t", name, "bool_and(@ = least(15, p.x + half) - greatest(0, p.x - half) + 1)")}"""


_BODY, _COUCH, _COARSE, _REFINED, _LEAST = "x BETWEEN 5 AND 9 AND y BETWEEN 3 AND 6 AND z BETWEEN 2 AND 5", "y >= 14", 1950, 1850, 3
_FIXATION = view_sql("hu").replace("WITH", "WITH RECURSIVE", 1) + f""", body AS (SELECT image, x, y, z FROM v_hu WHERE {_BODY}), {_labels_sql("body", "parts")},
clean AS (SELECT image, x, y, z FROM (SELECT *, first_value(label) OVER (PARTITION BY image ORDER BY size DESC, label) AS best FROM parts) WHERE label = best),
away AS (SELECT image, x, y, z FROM clean UNION SELECT image, x, y, z FROM v_hu WHERE {_COUCH}),
dense AS (SELECT image, x, y, z FROM v_hu WHERE raw >= {_REFINED} EXCEPT SELECT * FROM away), {_closing_sql("dense", 12, "wide")},
outside AS (SELECT image, x, y, z FROM wide EXCEPT SELECT * FROM away), low AS (SELECT image, z, x, max(y) AS low FROM clean GROUP BY ALL),
cut AS (SELECT i.image, i.z, c.x, coalesce(last_value(low IGNORE NULLS) OVER (PARTITION BY i.image, i.z ORDER BY c.x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(low IGNORE NULLS) OVER (PARTITION BY i.image, i.z ORDER BY c.x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS cut
  FROM (SELECT DISTINCT image, z FROM low) i CROSS JOIN (SELECT unnest(range(16)) AS x) c LEFT JOIN low ON low.image = i.image AND low.z = i.z AND low.x = c.x),
below AS (SELECT o.image, o.x, o.y, o.z FROM outside o JOIN cut ON cut.image = o.image AND cut.z = o.z AND cut.x = o.x WHERE o.y > cut),
spread AS (SELECT DISTINCT image, x, y, z + d AS z FROM below CROSS JOIN (VALUES (-1), (0), (1)) v(d) WHERE z + d BETWEEN 0 AND 7),
joined AS (SELECT s.image, s.x, s.y, s.z FROM spread s WHERE (SELECT count(*) FROM spread n WHERE n.image = s.image AND n.x = s.x AND n.y = s.y AND abs(n.z - s.z) <= 1) = 1 + CASE WHEN s.z > 0 THEN 1 ELSE 0 END + CASE WHEN s.z < 7 THEN 1 ELSE 0 END),
gear AS (SELECT * FROM joined j WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.image = j.image AND ((j.x - c.x) * {_SX}) ** 2 + ((j.y - c.y) * {_SY}) ** 2 + ((j.z - c.z) * {_SZ}) ** 2 <= 1.5 * 1.5 + 1e-9)),
reach AS (SELECT image, min(z) - 2 AS z0, max(z) + 2 AS z1 FROM clean GROUP BY image),
hard AS (SELECT h.image, x, y, z FROM v_hu h JOIN reach r ON r.image = h.image WHERE raw >= {_COARSE} AND z BETWEEN z0 AND z1 EXCEPT SELECT * FROM clean), {_closing_sql("hard", 2, "narrow")},
bulge AS (SELECT image, x, y, z FROM narrow EXCEPT SELECT * FROM clean), {_labels_sql("bulge", "lumps")}"""


@query(_FIXATION + f" SELECT {_XYZ} FROM (SELECT * FROM clean UNION SELECT * FROM gear UNION SELECT image, x, y, z FROM lumps WHERE size >= {_LEAST})")
def fixation(spark, sf_dir):
    """Both passes kept, so that the coarse one shows in the result."""
    hu = _hu(spark, sf_dir)
    found = voxels.fixation(
        hu, hu.where(_BODY), hu.where(_COUCH), ["image"], SHAPE, SPACING, coarse=F.lit(_COARSE), refined=F.lit(_REFINED), least=_LEAST, z_reach=2, body_margin=1.5, keep_bulge=True,
        tasks=tasks_of(spark, sf_dir, "hu"),
    )
    return found.select("image", *_long("x", "y", "z"))


@query(view_sql("hu") + """ SELECT image, CAST(15 - x AS BIGINT) AS x, CAST(15 - y AS BIGINT) AS y, CAST(z AS BIGINT) AS z,
  CAST(round_even(raw * 0.5 - 1000.0, 0) AS BIGINT) AS value FROM v_hu""")  # fmt: skip
def export_voxels(spark, sf_dir):
    return volumes.export_voxels(_hu(spark, sf_dir), F.lit(0.5), F.lit(-1000.0), 16, 16).select("image", *_long("x", "y", "z", "value"))


@query()
def nifti_volumes(spark, sf_dir):
    values = volumes.export_voxels(_hu(spark, sf_dir), F.lit(0.5), F.lit(-1000.0), 16, 16)
    packed = volumes.encode_volumes(values, "image", SHAPE, (0.0, 0.0, 0.0), ((1, 0, 0), (0, 1, 0), (0, 0, 1)), SPACING)
    return packed.select("image", F.length("content").cast("long").alias("bytes"), F.sha1("content").alias("digest"))


@query(view_sql("hu") + """ SELECT CAST(image AS VARCHAR) AS structure_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z, CAST(round_even(raw * 0.5 - 1000.0, 0) AS BIGINT) AS value
  FROM v_hu WHERE round_even(raw * 0.5 - 1000.0, 0) <> 0""")
def nifti_round_trip(spark, sf_dir):
    """Volumes written by the data source and read back; the mirrored axes are mirrored again."""
    values = volumes.export_voxels(_hu(spark, sf_dir), F.lit(0.5), F.lit(-1000.0), 16, 16)
    packed = volumes.encode_volumes(values, "image", SHAPE, (0.0, 0.0, 0.0), ((1, 0, 0), (0, 1, 0), (0, 0, 1)), SPACING)
    nifti.register(spark)
    path = fresh_path(spark, "nifti")
    packed.select(F.col("image").cast("string").alias("name"), "content").write.format("nifti").mode("append").save(path)
    return spark.read.format("nifti").load(path).select("structure_id", *_long("x", "y", "z", "value"))


_ROUND_TRIP_DIRS = ((0.0, 1.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 0.0, 1.0))


@query(view_sql("hu") + f""" SELECT image, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z, CAST(10.0 - y * {_SY} AS DOUBLE) AS px, CAST(-20.0 + x * {_SX} AS DOUBLE) AS py,
  CAST(5.0 + z * {_SZ} AS DOUBLE) AS pz, CAST(x AS BIGINT) AS ix, CAST(y AS BIGINT) AS iy, CAST(z AS BIGINT) AS iz FROM v_hu""")  # fmt: skip
def patient_points(spark, sf_dir):
    geometry = ((10.0, -20.0, 5.0), _ROUND_TRIP_DIRS, SPACING)
    at = voxels.to_patient(F.col("x"), F.col("y"), F.col("z"), *geometry)
    found = _hu(spark, sf_dir).select("image", "x", "y", "z", *[c.alias(n) for c, n in zip(at, ("px", "py", "pz"))])
    back = voxels.to_index(F.col("px"), F.col("py"), F.col("pz"), *geometry)
    return found.select("image", *_long("x", "y", "z"), *_round("px", "py", "pz"), *[c.cast("long").alias(n) for c, n in zip(back, ("ix", "iy", "iz"))])


# --- links -------------------------------------------------------------------------------------------------------

_LINKS = view_sql("node", "manual_edge") + """,
manual AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM v_manual_edge e JOIN v_node x ON x.node = a JOIN v_node y ON y.node = b
  WHERE x.set_id <> y.set_id AND x.patient_id = y.patient_id),
firsts AS (SELECT *, lower(trim(structure_id)) AS name FROM v_node WHERE lower(trim(structure_id)) <> ''
  QUALIFY row_number() OVER (PARTITION BY patient_id, lower(trim(structure_id)), set_id ORDER BY node) = 1),
chain AS (SELECT lag(node) OVER (PARTITION BY patient_id, name ORDER BY upper(set_id), set_id, node) AS p, node FROM firsts),
auto AS (SELECT least(p, node) AS a, greatest(p, node) AS b FROM chain WHERE p IS NOT NULL)"""


def _links(spark, sf_dir):
    nodes = view(spark, sf_dir, "node")
    return nodes, links.valid_edges(nodes, view(spark, sf_dir, "manual_edge")), links.auto_links(nodes)


@query(_LINKS + " SELECT a, b, true AS is_new FROM auto WHERE (a, b) NOT IN (SELECT (a, b) FROM manual) UNION ALL SELECT a, b, false FROM auto WHERE (a, b) IN (SELECT (a, b) FROM manual)")
def link_auto(spark, sf_dir):
    _, manual, auto = _links(spark, sf_dir)
    new = links.new_links(manual, auto)
    return new.withColumn("is_new", F.lit(True)).unionByName(links.remove_links(auto, new).withColumn("is_new", F.lit(False)))


@query(_LINKS + " SELECT (SELECT count(*) FROM manual) AS n_manual, (SELECT count(*) FROM auto WHERE (a, b) NOT IN (SELECT (a, b) FROM manual)) AS n_auto")
def link_counts(spark, sf_dir):
    _, manual, auto = _links(spark, sf_dir)
    return links.link_counts(manual, auto)


@query(_LINKS.replace("WITH", "WITH RECURSIVE", 1) + """,
e AS (SELECT a, b FROM manual UNION SELECT b, a FROM manual UNION SELECT a, b FROM auto UNION SELECT b, a FROM auto),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS node, least(a, min(b)) AS root FROM r GROUP BY a),
g AS (SELECT n.*, root, count(*) OVER (PARTITION BY root) AS size, set_id = 'Manual' AS truth,
  first_value(row(upper(set_id), set_id, upper(structure_id), structure_id)) OVER (PARTITION BY root ORDER BY upper(set_id), set_id, upper(structure_id), structure_id, n.node) AS f FROM v_node n JOIN c USING (node))
SELECT patient_id, dense_rank() OVER (PARTITION BY patient_id ORDER BY size DESC, f, root) AS group_no,
  row_number() OVER (PARTITION BY root ORDER BY CASE WHEN truth THEN 0 ELSE 1 END, upper(set_id), set_id, upper(structure_id), structure_id, node) AS member_no,
  CASE WHEN truth THEN 'GroundTruth' ELSE 'Compare' END AS role, set_id, structure_id, node, size FROM g""")  # fmt: skip
def link_groups(spark, sf_dir):
    nodes, manual, auto = _links(spark, sf_dir)
    found = links.link_groups(nodes, manual.unionByName(auto).distinct(), "Manual")
    return found.select("patient_id", *_long("group_no", "member_no"), "role", "set_id", "structure_id", "node", *_long("size"))


# one edit after the other, on the list of a patient's links as it stands
_REPLAYED = view_sql("node", "link_edit").replace("WITH", "WITH RECURSIVE", 1) + """,
named AS (SELECT * FROM v_node WHERE lower(trim(structure_id)) <> '' QUALIFY row_number() OVER (PARTITION BY patient_id, lower(trim(structure_id)), set_id ORDER BY node) = 1),
chained AS (SELECT patient_id, lag(node) OVER (PARTITION BY patient_id, lower(trim(structure_id)) ORDER BY upper(set_id), set_id, node) AS p, node FROM named),
auto AS (SELECT patient_id, list({'a': least(p, node), 'b': greatest(p, node)}) AS every FROM chained WHERE p IS NOT NULL GROUP BY patient_id),
edit AS (SELECT e.patient_id, op, e.set_id, least(e.a, e.b) AS a, greatest(e.a, e.b) AS b, coalesce(x.set_id <> y.set_id AND x.patient_id = y.patient_id AND x.patient_id = e.patient_id, false) AS valid,
    coalesce(every, []) AS every, row_number() OVER (PARTITION BY e.patient_id ORDER BY seq) AS k
  FROM v_link_edit e LEFT JOIN v_node x ON x.node = e.a LEFT JOIN v_node y ON y.node = e.b LEFT JOIN auto ON auto.patient_id = e.patient_id),
state AS (SELECT patient_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(a BIGINT, b BIGINT, manual BOOLEAN)[]) AS links, CAST(NULL AS VARCHAR) AS truth FROM edit GROUP BY patient_id
  UNION ALL SELECT s.patient_id, e.k, CASE op
      WHEN 'add' THEN CASE WHEN NOT valid OR len(list_filter(links, lambda l: l.a = e.a AND l.b = e.b)) > 0 THEN links ELSE list_append(links, {'a': e.a, 'b': e.b, 'manual': true}) END
      WHEN 'remove' THEN list_filter(links, lambda l: l.a <> e.a OR l.b <> e.b) WHEN 'clear' THEN CAST([] AS STRUCT(a BIGINT, b BIGINT, manual BOOLEAN)[])
      WHEN 'auto' THEN list_concat(links, list_transform(list_filter(every, lambda n: len(list_filter(links, lambda l: l.a = n.a AND l.b = n.b)) = 0), lambda n: {'a': n.a, 'b': n.b, 'manual': false}))
      ELSE links END, CASE WHEN op = 'truth' THEN e.set_id ELSE truth END
  FROM state s JOIN edit e ON e.patient_id = s.patient_id AND e.k = s.k + 1),
final AS (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY k DESC) = 1)"""


@query(_REPLAYED + " SELECT patient_id, l.a AS a, l.b AS b, l.manual AS manual, truth AS ground_truth FROM (SELECT patient_id, truth, unnest(links) AS l FROM final)")
def link_edits(spark, sf_dir):
    kept, truths = links.replay(view(spark, sf_dir, "node"), view(spark, sf_dir, "link_edit"))
    return kept.join(truths, "patient_id", "left").select("patient_id", "a", "b", "manual", "ground_truth")


# --- labels, notes and checks ------------------------------------------------------------------------------------


def _marked(text: str, digit: bool = False) -> str:
    """SQL of a label with ``<`` where a side word may start and ``>`` where one may end, in place of looking around."""
    if digit:
        text = f"regexp_replace({text}, '([A-Za-z][A-Za-z])([0-9])', '\\1>\\2', 'g')"
    text = f"regexp_replace({text}, '([a-z0-9])(>?[A-Z])', '\\1><\\2', 'g')"
    text = f"regexp_replace({text}, '([A-Z])([a-z])', '\\1<\\2', 'g')"
    return f"('<' || regexp_replace({text}, '([ _-])', '>\\1<', 'g') || '>')"


def _words(words: list[str]) -> str:
    """A pattern of any of the words in a marked label, in any case, whatever marks lie inside."""
    fold = lambda c: f"[{c.lower()}{c.upper()}]" if c.upper() != c.lower() else c
    return "<>?(" + "|".join("[<>]*".join(map(fold, w)) for w in words) + ")<?>"


def side_sql(text: str, digit: bool = False) -> str:
    """SQL of the side that a text names."""
    marked = _marked(f"replace(replace({text}, '<', '?'), '>', '?')", digit)
    left, right = (f"regexp_matches({marked}, '{_words(w)}')" for w in (T.LEFT_WORDS, T.RIGHT_WORDS))
    return f"CASE WHEN {left} AND {right} THEN 'AMBIGUOUS' WHEN {left} THEN 'LEFT' WHEN {right} THEN 'RIGHT' ELSE 'NONE' END"


_LABELS = view_sql("plan") + ", labels AS (SELECT plan_id AS label FROM v_plan UNION ALL SELECT coalesce(site, '') FROM v_plan)"


def _labels(spark, sf_dir):
    plan = view(spark, sf_dir, "plan")
    return plan.select(F.col("plan_id").alias("label")).unionByName(plan.select(F.coalesce("site", F.lit("")).alias("label"))).groupBy("label").agg(F.count("*").alias("n"))


@query(_LABELS + f" SELECT label, n, {side_sql('label', False)} AS side FROM (SELECT label, count(*) AS n FROM labels GROUP BY label)")
def laterality_a(spark, sf_dir):
    return _labels(spark, sf_dir).select("label", "n", T.laterality("label").alias("side"))


_LONG_BREAST = f"(?i)({'|'.join(T.BREAST_WORDS)})"
_STRIPPED = f"regexp_replace(regexp_replace({_marked(f"regexp_replace(label, '{_LONG_BREAST}', ' ', 'g')", True)}, '{_words(T.BREAST_SHORT)}', ' ', 'g'), '[<>]', '', 'g')"
_BREAST = f"(regexp_matches(label, '{_LONG_BREAST}') OR regexp_matches({_marked('label', True)}, '{_words(T.BREAST_SHORT)}'))"


@query(_LABELS + f" SELECT label, n, {side_sql('x', True)} AS side, breast FROM (SELECT label, count(*) AS n, {_STRIPPED} AS x, {_BREAST} AS breast FROM labels GROUP BY label)")
def laterality_b(spark, sf_dir):
    return _labels(spark, sf_dir).select("label", "n", T.site_laterality("label").alias("side"), T.breast_site("label").alias("breast"))


_VERDICT = """CASE WHEN p = 'AMBIGUOUS' OR r = 'AMBIGUOUS' THEN 'WARNING' WHEN p = 'NONE' AND r = 'NONE' THEN 'OK' WHEN p = 'NONE' OR r = 'NONE' THEN 'WARNING' WHEN p = r THEN 'OK' ELSE 'WARNING' END"""


@query(view_sql("plan") + f""" SELECT plan_no, p AS plan_side, r AS rx_side, {_VERDICT} AS verdict
  FROM (SELECT *, {side_sql('plan_id', False)} AS p, {side_sql("coalesce(site, '')", False)} AS r FROM v_plan)""")  # fmt: skip
def laterality_verdict(spark, sf_dir):
    found = view(spark, sf_dir, "plan").select("plan_no", T.laterality("plan_id").alias("plan_side"), T.laterality("site").alias("rx_side"))
    return found.withColumn("verdict", rules.side_verdict(F.col("plan_side"), F.col("rx_side")))


def _axis_sql(axis: str) -> str:
    pattern = rf"^\s*(?i:{'|'.join(T.AXIS_LABELS[axis])})\b.*?([+−-]?\s*\d+(?:[.,]\d+)?)\s*((?i:mm|cm))?"
    number = f"TRY_CAST(replace(replace(replace(regexp_extract(t, '{pattern}', 1), '−', '-'), ' ', ''), ',', '.') AS DOUBLE)"
    return f"list_filter(list_transform(string_split(coalesce(note, ''), chr(10)), lambda t: CASE WHEN lower(regexp_extract(t, '{pattern}', 2)) = 'mm' THEN {number} / 10 ELSE {number} END), lambda v: v IS NOT NULL)[1]"


_SHIFTS = view_sql("note", "plan") + f", shifts AS (SELECT note_id, note, {_axis_sql('lng')} AS lng, {_axis_sql('lat')} AS lat, {_axis_sql('vrt')} AS vrt FROM v_note)"
# of the lateral lines up to the first with a number, the last bracket
_LATERAL = "list_filter(string_split(coalesce(note, ''), chr(10)), lambda t: regexp_matches(t, '^\\s*(?i:" + "|".join(T.AXIS_LABELS["lat"]) + ")\\b'))"
_ANNOTATED = f""", laterals AS (SELECT *, {_LATERAL} AS lines FROM shifts), valued AS (SELECT *, list_position(list_transform(lines, lambda t: regexp_matches(t, '^\\s*[A-Za-z]+\\b.*?[0-9]')), true) AS place FROM laterals),
brackets AS (SELECT *, list_filter(lines[1 : coalesce(nullif(place, 0), len(lines))], lambda t: regexp_matches(t, '[(][^)]*[)]')) AS found FROM valued),
noted AS (SELECT *, coalesce(regexp_extract(found[len(found)], '[(]([^)]*)[)]', 1), '') AS label FROM brackets), annotated AS (SELECT * EXCLUDE (lines, place, found, label), {side_sql(_STRIPPED, True)} AS annotation FROM noted)"""


@query(_SHIFTS + _ANNOTATED + " SELECT note_id, round(lng, 6) + 0.0 AS lng, round(lat, 6) + 0.0 AS lat, round(vrt, 6) + 0.0 AS vrt, annotation FROM annotated")
def note_shift(spark, sf_dir):
    found = view(spark, sf_dir, "note").select("note_id", *[T.note_shift("note", a).alias(a) for a in ("lng", "lat", "vrt")], T.note_annotation("note").alias("a"))
    shifts = [(F.round(c, 6) + 0.0).alias(c) for c in ("lng", "lat", "vrt")]  # no minus zero
    return found.select("note_id", *shifts, T.site_laterality("a").alias("annotation"))


@query(_SHIFTS + _ANNOTATED + f""", sided AS (SELECT plan_no, orientation, lat, vrt, annotation, {side_sql(_STRIPPED.replace('label', 'plan_id'), True)} AS p,
  {side_sql(_STRIPPED.replace('label', "coalesce(site, '')"), True)} AS r, {_BREAST.replace('label', 'plan_id')} OR {_BREAST.replace('label', "coalesce(site, '')")} AS breast
  FROM v_plan JOIN annotated ON note_id = plan_no),
t AS (SELECT *, CASE WHEN p <> 'NONE' THEN p ELSE r END AS treated, CASE WHEN (lat > 0) = ((contains(orientation, 'Prone')) = (starts_with(orientation, 'FeetFirst'))) THEN 'RIGHT' ELSE 'LEFT' END AS implied FROM sided)
SELECT plan_no, treated, CASE WHEN treated = 'NONE' THEN 'OK' WHEN treated = 'AMBIGUOUS' OR lat IS NULL OR orientation IS NULL OR contains(orientation, 'Decubitus') OR orientation IN ('Sitting', 'NoOrientation') THEN 'INCONCLUSIVE'
  WHEN abs(lat) < 1e-9 THEN 'WARNING' WHEN implied = treated AND NOT (annotation IN ('LEFT', 'RIGHT') AND annotation <> implied) THEN 'OK' ELSE 'WARNING' END AS lateral,
  CASE WHEN NOT breast THEN 'OK' WHEN vrt IS NULL THEN 'INCONCLUSIVE' WHEN vrt > 0 THEN 'OK' ELSE 'WARNING' END AS vertical FROM t""")  # fmt: skip
def shift_check(spark, sf_dir):
    plan, note = view(spark, sf_dir, "plan"), view(spark, sf_dir, "note").withColumnRenamed("note_id", "plan_no")
    sided = plan.join(note, "plan_no").select(
        "plan_no", "orientation", T.note_shift("note", "lat").alias("lat"), T.note_shift("note", "vrt").alias("vrt"), T.site_laterality(T.note_annotation("note")).alias("annotation"),
        rules.treated_side(T.site_laterality("plan_id"), T.site_laterality("site")).alias("treated"), (T.breast_site("plan_id") | T.breast_site("site")).alias("breast"),
    )
    lateral = rules.lateral_check(F.col("treated"), F.col("lat"), F.col("orientation"), F.col("annotation"))
    return sided.select("plan_no", "treated", lateral.alias("lateral"), rules.vertical_check(F.col("vrt"), F.col("breast")).alias("vertical"))


@query(view_sql("beam") + """, ref AS (SELECT * FROM v_beam WHERE is_setup QUALIFY row_number() OVER (PARTITION BY plan_no ORDER BY pos, lat_mm NULLS FIRST, lng_mm, vrt_mm) = 1)
SELECT b.plan_no, CAST(b.pos AS BIGINT) AS pos, """ + ", ".join(
    f"CASE WHEN isnan(b.{c}) OR isnan(r.{c}) THEN NULL ELSE round(b.{c} - r.{c}, 6) END AS d_{c}" for c in ("lat_mm", "lng_mm", "vrt_mm")
) + " FROM v_beam b JOIN ref r ON r.plan_no = b.plan_no WHERE NOT b.is_setup")
def beam_delta(spark, sf_dir):
    return rules.beam_delta(view(spark, sf_dir, "beam")).select("plan_no", *_long("pos"), *_round("d_lat_mm", "d_lng_mm", "d_vrt_mm"))


@query(view_sql("beam") + " SELECT plan_no, CAST(pos AS BIGINT) AS pos, row_number() OVER (PARTITION BY plan_no ORDER BY CASE WHEN is_setup THEN 0 ELSE 1 END, pos) AS place FROM v_beam")
def beam_order(spark, sf_dir):
    return rules.beams_in_order(view(spark, sf_dir, "beam")).select("plan_no", *_long("pos", "place"))


# --- planning ----------------------------------------------------------------------------------------------------

_SPINE = "[" + ", ".join(f"'{v}'" for v in T.SPINE) + "]"
# the spine as a table of (region, number as written, place, token); a label's head and what follows it are read apart
_LEVELS = "(VALUES " + ", ".join(f"('{v.rstrip('0123456789').upper()}', '{v.lstrip('CThLS')}', {k + 1}, '{v}')" for k, v in enumerate(T.SPINE)) + ")"
_RX = view_sql("rx") + f""", heads AS (SELECT *, regexp_extract(label, '^\\s*([A-Za-z]+)\\s*([0-9]+)((?s).*)$', ['r', 'n', 'rest']) AS h FROM v_rx WHERE label IS NOT NULL),
tails AS (SELECT *, regexp_extract(h.rest, '^\\s*-\\s*([A-Za-z]*)\\s*([0-9]+)', ['r', 'n']) AS t FROM heads),
ends AS (SELECT *, t.n <> '' AND (t.r = '' OR upper(t.r) IN (SELECT r FROM {_LEVELS} v(r, n, k, v))) AS ranged FROM tails),
found AS (SELECT course, rx_id, CASE WHEN b.v <> a.v THEN a.v || '-' || b.v ELSE a.v END AS name, list_slice({_SPINE}, least(a.k, coalesce(b.k, a.k)), greatest(a.k, coalesce(b.k, a.k))) AS tokens
  FROM ends e JOIN {_LEVELS} a(r, n, k, v) ON a.r = upper(e.h.r) AND a.n = e.h.n
  LEFT JOIN {_LEVELS} b(r, n, k, v) ON e.ranged AND b.r = upper(CASE WHEN e.t.r = '' THEN e.h.r ELSE e.t.r END) AND b.n = e.t.n WHERE NOT e.ranged OR b.k IS NOT NULL),
rx AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY course, name ORDER BY rx_id) = 1)"""


@query(_RX + " SELECT course, rx_id, name, array_to_string(tokens, ',') AS tokens, array_to_string(list_transform(tokens, lambda t: 'vertebrae_' || regexp_replace(t, '^Th', 'T')), ',') AS segments FROM rx")
def rx_match(spark, sf_dir):
    found = planning.prescriptions(view(spark, sf_dir, "rx"))
    return found.select("course", "rx_id", "name", F.array_join("tokens", ",").alias("tokens"), F.array_join("segments", ",").alias("segments"))


@query(view_sql("dose") + """, ids AS (SELECT plan_no, list(DISTINCT structure_id ORDER BY structure_id) AS ids FROM v_dose GROUP BY plan_no)
SELECT plan_no, replace(replace(array_to_string(ids, ','), 'lung_left', 'lung_upper_lobe_left,lung_lower_lobe_left'), 'lung_right', 'lung_upper_lobe_right,lung_middle_lobe_right,lung_lower_lobe_right') AS segments FROM ids""")  # fmt: skip
def roi_expand(spark, sf_dir):
    ids = view(spark, sf_dir, "dose").groupBy("plan_no").agg(F.array_sort(F.collect_set("structure_id")).alias("ids"))
    return ids.select("plan_no", F.array_join(planning.expand_parts(F.col("ids")), ",").alias("segments"))


@query(view_sql("structure") + """, req(structure_id) AS (VALUES ('heart'), ('SpinalCord'), ('lung_l'), ('Liver')),
own AS (SELECT *, CAST(floor(seq / 40) AS BIGINT) AS set_no FROM v_structure), one AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY set_no, upper(structure_id) ORDER BY seq) = 1)
SELECT s.set_no, r.structure_id, CASE WHEN o.seq IS NULL THEN 'missing' ELSE 'empty' END AS problem FROM (SELECT DISTINCT set_no FROM own) s CROSS JOIN req r
LEFT JOIN one o ON o.set_no = s.set_no AND upper(o.structure_id) = upper(r.structure_id) WHERE o.seq IS NULL OR o.is_empty""")  # fmt: skip
def verify_missing(spark, sf_dir):
    own = view(spark, sf_dir, "structure").withColumn("set_no", F.floor(F.col("seq") / 40))
    wanted = F.explode(F.array(*[F.lit(x) for x in ("heart", "SpinalCord", "lung_l", "Liver")]))
    return planning.missing_required(own.select("set_no").distinct().select("set_no", wanted.alias("structure_id")), own)


_MV = "TRY_CAST(nullif(regexp_extract(plan_id, '^(?i)MV([0-9]+)_', 1), '') AS BIGINT)"


@query(view_sql("plan_id") + f" SELECT course, coalesce(max({_MV}), 0) AS highest, coalesce(min(CASE WHEN {_MV} > 0 THEN {_MV} END), 99) AS lowest FROM v_plan_id GROUP BY course")
def highest_mv(spark, sf_dir):
    plans = view(spark, sf_dir, "plan_id")
    return planning.highest_mv(plans).join(planning.lowest_mv(plans, F.lit(99)), "course").select("course", *_long("highest", "lowest"))


@query(_RX + ", " + view_sql("plan_id").removeprefix("WITH ") + f""", top AS (SELECT course, coalesce(max({_MV}), 0) AS highest FROM v_plan_id GROUP BY course)
SELECT * FROM (SELECT course, rx_id, 'MV' || (coalesce(highest, 0) + row_number() OVER (PARTITION BY course ORDER BY rx_id)) || '_' || name || '_8' AS plan_id FROM rx LEFT JOIN top USING (course)) WHERE length(plan_id) <= 16""")  # fmt: skip
def next_plan_id(spark, sf_dir):
    return planning.number_new_plans(planning.prescriptions(view(spark, sf_dir, "rx")), view(spark, sf_dir, "plan_id"))


@query(view_sql("plan_id") + """, base AS (SELECT DISTINCT course, regexp_replace(plan_id, ' kopi [0-9]+$', '') AS base FROM v_plan_id)
SELECT course, base, CAST(min(n) AS BIGINT) AS number FROM base CROSS JOIN (SELECT unnest(range(1, 30)) AS n) WHERE NOT EXISTS (SELECT 1 FROM v_plan_id p WHERE p.course = base.course AND p.plan_id = base || ' kopi ' || n) GROUP BY course, base""")  # fmt: skip
def free_copy_number(spark, sf_dir):
    return planning.free_copy_number(view(spark, sf_dir, "plan_id"), F.regexp_replace("plan_id", " kopi [0-9]+$", "")).select("course", "base", *_long("number"))


# two wanted plans for each course: one whose target has plans already, and one whose target has none
_WANTED = "w AS (SELECT DISTINCT course, 50 AS mv, 'Th9' AS name, t AS target_id FROM v_plan_id CROSS JOIN (VALUES ('PTV_1'), ('PTV_9')) x(t))"


@query(view_sql("plan_id") + f""", p AS (SELECT course, plan_id, 'ptv_' || seq % 3 AS target_id FROM v_plan_id), {_WANTED},
e AS (SELECT w.*, (SELECT count(*) FROM p WHERE p.course = w.course AND upper(p.target_id) = w.target_id) AS existing,
  coalesce((SELECT min({_MV}) FROM p WHERE p.course = w.course AND upper(p.target_id) = w.target_id AND {_MV} > 0), mv) AS x FROM w),
f AS (SELECT course, target_id, min(y) AS y FROM e CROSS JOIN (SELECT unnest(range(1, 60)) AS y) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.course = e.course AND upper(p.plan_id) = 'MV' || x || ' KOPI ' || y) GROUP BY ALL)
SELECT course, target_id, CASE WHEN existing = 0 THEN 'MV50_Th9_8' ELSE 'MV' || x || ' kopi ' || y END AS plan_id FROM e JOIN f USING (course, target_id)""")  # fmt: skip
def plan_id_choice(spark, sf_dir):
    own = view(spark, sf_dir, "plan_id")
    plans = own.select("course", "plan_id", F.concat(F.lit("ptv_"), (F.col("seq") % 3).cast("string")).alias("target_id"))
    wanted = own.select("course").distinct().select("course", F.lit(50).alias("mv"), F.lit("Th9").alias("name"), F.explode(F.array(F.lit("PTV_1"), F.lit("PTV_9"))).alias("target_id"))
    return planning.plan_ids(wanted, plans).select("course", "target_id", "plan_id")


@query(view_sql("image") + " SELECT patient_id, image_id FROM v_image WHERE contains(upper(image_id), 'KVCBCT') QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY created DESC NULLS LAST, seq) = 1")
def newest_image(spark, sf_dir):
    return planning.newest_image(view(spark, sf_dir, "image")).select("patient_id", "image_id")


@query(view_sql("image", "plan_id") + " SELECT DISTINCT patient_id, image_id FROM v_image WHERE patient_id IN (SELECT course FROM v_plan_id WHERE plan_id LIKE 'MV%')")
def series_calculated(spark, sf_dir):
    series = view(spark, sf_dir, "image").select(F.col("patient_id").alias("series_id"), "image_id").distinct()
    plans = view(spark, sf_dir, "plan_id").select(F.col("course").alias("series_id"), F.col("plan_id").startswith("MV").alias("is_calculated"))
    return planning.calculated_on_series(series, plans).select(F.col("series_id").alias("patient_id"), "image_id")


@query(view_sql("plan_id") + """, p AS (SELECT course, seq, plan_id, 'RP' || seq % 3 AS point_id FROM v_plan_id), t AS (SELECT course, point_id FROM p GROUP BY ALL HAVING count(DISTINCT plan_id) > 1)
SELECT p.course, p.seq, CASE WHEN p.point_id = 'RP0' THEN 'already' WHEN t.point_id IS NOT NULL THEN 'taken' WHEN seq % 5 = 0 THEN 'primary' WHEN seq % 5 = 1 THEN 'plan-named' WHEN seq % 5 = 2 THEN 'only' ELSE 'none' END AS decision
FROM p LEFT JOIN t ON t.course = p.course AND t.point_id = p.point_id""")  # fmt: skip
def refpoint_decision(spark, sf_dir):
    points = view(spark, sf_dir, "plan_id").withColumn("point_id", F.concat(F.lit("RP"), (F.col("seq") % 3).cast("string")))
    taken = planning.taken_reference_points(points).select("course", "point_id").distinct().withColumn("taken", F.lit(True))
    rest = lambda k, name: F.when(F.col("seq") % 5 == k, name)
    decision = rules.reference_point_decision(F.col("point_id"), F.lit("RP0"), F.coalesce("taken", F.lit(False)), rest(0, "a"), rest(1, "b"), rest(2, "c"))
    return points.join(taken, ["course", "point_id"], "left").select("course", "seq", decision.alias("decision"))


# --- scores and searches -----------------------------------------------------------------------------------------

_GOALS = "(VALUES " + ", ".join(f"('{s}', {str(t).lower()}, '{m}', {limit}, {p})" for s, t, m, limit, p in search.GOALS) + ") g(goal_id, is_target, metric, limit_gy, priority)"


@query(view_sql("dose") + f""", s AS (SELECT plan_no, structure_id, max(gy) AS mx, min(gy) AS mn, avg(gy) AS av FROM (SELECT *, CASE unit WHEN 'Gy' THEN dose WHEN 'cGy' THEN dose / 100 END AS gy FROM v_dose) GROUP BY ALL),
v AS (SELECT plan_no, priority, CASE metric WHEN 'max' THEN mx - limit_gy WHEN 'min' THEN limit_gy - mn ELSE av - limit_gy END AS x FROM s JOIN {_GOALS} ON CASE WHEN is_target THEN starts_with(structure_id, 'PTV') ELSE structure_id = goal_id END)
SELECT plan_no, round(sum(priority * greatest(x, 0) ** 2) + 0.0001234, 3) AS score, count(*) AS n_goals FROM v GROUP BY plan_no""")  # fmt: skip
def plan_score(spark, sf_dir):
    # many scores end in half a thousandth, which the last bit of a sum would decide
    return search.plan_score(view(spark, sf_dir, "dose")).select("plan_no", F.round(F.col("score") + 0.0001234, 3).alias("score"), "n_goals")


@query(view_sql("dose") + f""" SELECT DISTINCT plan_no, structure_id, goal_id, CASE metric WHEN 'max' THEN 'upper' WHEN 'min' THEN 'lower' ELSE 'mean' END AS objective, CAST(limit_gy AS DOUBLE) AS limit_gy
  FROM v_dose JOIN {_GOALS} ON CASE WHEN is_target THEN starts_with(structure_id, 'PTV') ELSE structure_id = goal_id END""")  # fmt: skip
def objectives(spark, sf_dir):
    found = search.objectives(view(spark, sf_dir, "dose").select("plan_no", "structure_id").distinct())
    ids = F.array(*[F.lit(g[0]) for g in search.GOALS])
    return found.select("plan_no", "structure_id", F.get(ids, F.col("goal_no")).alias("goal_id"), "objective", "limit_gy")


def _search_sql(coarse: str, low: float, high: float, reach: float, step: float, decimals: int, cost: str) -> str:
    return view_sql("plan") + f""", c AS (SELECT plan_no, v, o, {cost} AS cost FROM v_plan CROSS JOIN (SELECT unnest({coarse}) AS v, unnest(range(len({coarse}))) AS o)),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY plan_no ORDER BY cost, o) = 1),
f0 AS (SELECT plan_no, unnest(list_transform(range(0, CAST(floor((least(v + {reach}, {high}) - greatest(v - {reach}, {low})) / {step} + 1e-6) AS BIGINT) + 1), lambda i: round(greatest(v - {reach}, {low}) + i * {step}, {decimals}))) AS v FROM b),
f AS (SELECT plan_no, v, {cost} AS cost FROM f0 WHERE NOT list_contains({coarse}, v)), u AS (SELECT plan_no, v, cost, 0 AS late, o FROM c UNION ALL SELECT plan_no, v, cost, 1, v FROM f)
SELECT plan_no, first(v ORDER BY cost, late, o) AS best_value, round(min(cost), 6) AS best_cost, count(*) AS n_tried FROM u GROUP BY plan_no"""


# the dose engine is outside of the library: a synthetic cost stands in for it
_HINGE = "[30.0::DOUBLE, 50, 70, 90, 110, 130]"


@query(_search_sql(_HINGE, 20, 160, 20, 5, 1, "(v - (20 + plan_no % 141)) ** 2 / 100"))
def hinge_search(spark, sf_dir):
    plans = view(spark, sf_dir, "plan").select("plan_no")
    found = search.hinge_search(plans, lambda v: F.pow(v - (20 + F.col("plan_no") % 141), F.lit(2.0)) / 100)
    return found.select("plan_no", "best_value", *_round("best_cost"), *_long("n_tried"))


@query(view_sql("plan", "candidate") + """, grid AS (SELECT DISTINCT plan_no, 30.0 + 20 * o AS v, o FROM v_plan CROSS JOIN (SELECT unnest(range(6)) AS o)),
cost AS (SELECT plan_no, value AS v, min(cost) AS cost FROM v_candidate WHERE cost IS NOT NULL GROUP BY ALL), c AS (SELECT plan_no, v, o, coalesce(cost, 'inf'::DOUBLE) AS cost FROM grid LEFT JOIN cost USING (plan_no, v)),
b AS (SELECT plan_no, v FROM c WHERE cost < 'inf'::DOUBLE QUALIFY row_number() OVER (PARTITION BY plan_no ORDER BY cost, o) = 1),
f AS (SELECT b.plan_no, s.v, coalesce(cost, 'inf'::DOUBLE) AS cost FROM b JOIN (SELECT 20.0 + 5 * unnest(range(29)) AS v) s ON s.v BETWEEN greatest(20, b.v - 20) AND least(160, b.v + 20) LEFT JOIN cost ON cost.plan_no = b.plan_no AND cost.v = s.v
  WHERE s.v NOT IN (30, 50, 70, 90, 110, 130)), u AS (SELECT plan_no, v, cost, 0 AS late, o FROM c UNION ALL SELECT plan_no, v, cost, 1, CAST(v AS BIGINT) FROM f)
SELECT plan_no, CASE WHEN min(cost) < 'inf'::DOUBLE THEN CAST(first(v ORDER BY cost, late, o) AS DOUBLE) END AS best_value, CASE WHEN min(cost) < 'inf'::DOUBLE THEN round(min(cost), 6) END AS best_cost, count(*) AS n_tried FROM u GROUP BY plan_no""")
def table_search(spark, sf_dir):
    found = search.table_search(view(spark, sf_dir, "plan").select("plan_no"), view(spark, sf_dir, "candidate"), (30.0, 140.0, 20.0), 20.0, 5.0, (20.0, 160.0), 1)
    return found.select("plan_no", "best_value", *_round("best_cost"), *_long("n_tried"))


@query(_search_sql("[0.5::DOUBLE, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85]", 0.5, 0.85, 0.05, 0.025, 3, "abs(v - (0.45 + (plan_no % 50) * 0.01003))"))
def pa_search(spark, sf_dir):
    plans = view(spark, sf_dir, "plan").select("plan_no")
    found = search.fraction_search(plans, lambda v: F.abs(v - (0.45 + (F.col("plan_no") % 50) * 0.01003)))
    return found.select("plan_no", "best_value", *_round("best_cost"), *_long("n_tried"))


_ISO = "(CASE WHEN pos % 5 = 0 THEN NULL ELSE lng_mm END)"


@query(view_sql("beam") + f""", j AS (SELECT *, 0 - lng_mm AS x1, coalesce(lat_mm, 0) * 3 AS x2, {_ISO} + 10 - 300 AS sh FROM v_beam)
SELECT plan_no, CAST(pos AS BIGINT) AS pos, CASE WHEN pos % 7 = 0 OR sh IS NULL OR sh <= 0 THEN 0 WHEN sh > 60 THEN 60 ELSE round(sh, 6) END AS iso_shift,
  round(CASE WHEN x2 - x1 > 170 THEN (x1 + x2) / 2 - 85 ELSE x1 END, 6) AS x1, round(CASE WHEN x2 - x1 > 170 THEN (x1 + x2) / 2 + 85 ELSE x2 END, 6) AS x2,
  round(((180 - lng_mm / 2) % 360 + 360) % 360, 6) AS first, round(((180 + lng_mm / 2) % 360 + 360) % 360, 6) AS second,
  CASE WHEN lng_mm > 0 AND 8 > 0 THEN round((CASE WHEN lat_mm IS NULL THEN 100 ELSE lat_mm END) * lng_mm / 8, 4) END AS normalisation FROM j""")  # fmt: skip
def geometry_rules(spark, sf_dir):
    beams = view(spark, sf_dir, "beam").withColumn("jaw", rules.jaw_clamp(0 - F.col("lng_mm"), F.coalesce("lat_mm", F.lit(0.0)) * 3)).withColumn("pair", rules.pair_angles(F.col("lng_mm")))
    surface = F.when(F.col("pos") % 5 != 0, F.col("lng_mm"))
    shift = rules.isocentre_shift(F.col("pos") % 7 != 0, surface, F.lit(300.0))
    norm = rules.normalisation(F.col("lat_mm"), F.col("lng_mm"), F.lit(8.0))
    return beams.select("plan_no", *_long("pos"), F.round(shift, 6).alias("iso_shift"), *[F.round(f"jaw.{c}", 6).alias(c) for c in ("x1", "x2")], *[F.round(f"pair.{c}", 6).alias(c) for c in ("first", "second")], F.round(norm, 4).alias("normalisation"))


@query(view_sql("plan") + """, r AS (SELECT count(*) AS points, round(sum(i / 177.0), 6) AS total, max(CASE WHEN i = 59 THEN round(i / 177.0, 9) END) AS third FROM (SELECT unnest(range(178)) AS i))
SELECT plan_no, points, total, third FROM v_plan CROSS JOIN r""")  # fmt: skip
def meterset(spark, sf_dir):
    found = view(spark, sf_dir, "plan").select("plan_no", rules.meterset_ramp().alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, b: a + b)
    return found.select("plan_no", F.size("w").cast("long").alias("points"), F.round(total, 6).alias("total"), F.round(F.get("w", F.lit(59)), 9).alias("third"))


@query(view_sql("plan") + """, t AS (SELECT plan_no, CASE plan_no % 4 WHEN 0 THEN 'SingleArc' WHEN 1 THEN 'DualArc' WHEN 2 THEN 'ApPa' ELSE 'StaticPair' END AS technique FROM v_plan)
SELECT plan_no, technique, CAST(b.start AS DOUBLE) AS start, CAST(b.stop AS DOUBLE) AS stop, b.direction, CAST(b.collimator AS DOUBLE) AS collimator FROM t JOIN (VALUES ('SingleArc', 181, 179, 'CW', 30), ('DualArc', 181, 179, 'CW', 30),
  ('DualArc', 179, 181, 'CCW', 330), ('ApPa', 180, 180, 'NONE', 0), ('ApPa', 0, 0, 'NONE', 0)) b(n, start, stop, direction, collimator) ON n = technique""")  # fmt: skip
def beam_tables(spark, sf_dir):
    k = F.col("plan_no") % 4
    found = view(spark, sf_dir, "plan").select("plan_no", F.when(k == 0, "SingleArc").when(k == 1, "DualArc").when(k == 2, "ApPa").otherwise("StaticPair").alias("technique"))
    return found.select("plan_no", "technique", F.inline(rules.beam_table(F.col("technique"))))


@query(view_sql("structure") + """, s AS (SELECT DISTINCT patient_id, set_id FROM v_structure)
SELECT patient_id, set_id, CASE WHEN set_id = 'Replan' AND patient_id % 5 = 0 THEN 'locked' END AS error, CASE WHEN set_id = 'Replan' AND patient_id % 5 <> 0 THEN 'Adapted' ELSE set_id END AS new_id FROM s""")  # fmt: skip
def rename_set(spark, sf_dir):
    sets = view(spark, sf_dir, "structure").select("patient_id", "set_id").distinct()
    return rules.rename_set(sets, "Replan", "Adapted", F.col("patient_id") % 5 == 0).select("patient_id", "set_id", "error", "new_id")


@query(view_sql("plan", "beam") + """ SELECT plan_no, CASE WHEN strpos(x, '=') > 0 THEN substr(x, strpos(x, '=') + 1) ELSE x END AS stripped, regexp_replace(x, '[^\\p{L}\\p{Nd}]', '_', 'g') AS file_name, replace(x, ';', ',') AS field,
  CASE WHEN plan_no % 300 >= 60 THEN (plan_no % 300) // 60 || 'm ' || lpad(CAST((plan_no % 300) % 60 AS VARCHAR), 2, '0') || 's' ELSE (plan_no % 300) || '.0s' END AS took FROM (SELECT plan_no, plan_id || ';rx=' || coalesce(site, '') AS x FROM v_plan)""")  # fmt: skip
def text_tools(spark, sf_dir):
    found = view(spark, sf_dir, "plan").select("plan_no", F.concat("plan_id", F.lit(";rx="), F.coalesce("site", F.lit(""))).alias("x"))
    seconds = (F.col("plan_no") % 300).cast("double")
    return found.select("plan_no", T.strip_label("x").alias("stripped"), T.file_name("x").alias("file_name"), T.export_field("x").alias("field"), T.duration(seconds).alias("took"))
