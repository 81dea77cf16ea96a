"""Domain views over the driver tables.

The driver's tables hold orders and parts, not plans and structures.  These views derive the domain's tables from them by
integer arithmetic and literal tables only, in SQL that Spark and DuckDB read alike, so both engines start from the same
rows.  ``{part}`` and the like stand for the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoplane.operators.groups import placed, tasks
from isoplane.operators.matching import gather
from isoplane.operators.voxels import Grid


def _values(rows: list[tuple], names: str) -> str:
    def one(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS {names}"


# Structure set names and the spellings of ten organs in them.
SETS = ["Manual", "AutoContour1", "TotalSegAuto", "Replan"]
SPELLINGS = [
    ["SpinalCord", "spinal_cord", "Spinal-Cord", "SPINALCORD"],
    ["Parotid_L", "parotid_left", "ParotidL", "parotid_sin"],
    ["Parotid_R", "parotid_dxt", "Parotid.Right", "parotid_right"],
    ["Th11", "T11", "vertebrae_T11", "T11_Left"],
    ["L1", "vertebrae_L1", "L01", "Vert L1"],
    ["BODY", "Body", " BODY ", "body"],
    ["L_R", "Corpus", "", "  "],
    ["Lung_S", "lung sin", "Lung_L", "Lungs"],
    ["PTV_8", "PTV-8", "ptv8", "PTV_D"],
    ["Heart", "heart", "Heart/1", "T11-T12"],
]
# parts of labels, of which the views put three together
LABEL_PARTS = ["Lung", "PTV", "Breast", "IMN", "OAR", "Rectum", "Br", "br3", "mamma", "Mam2", "Cord", "L1", "x", ""]
LABEL_MARKS = ["", "_", " ", "-", "8", "Px"]
LABEL_ENDS = ["L", "R", "s", "D", "left", "Right", "sin", "dxT", "venstre", "HØYRE", "høyre", "Lr", "Leftover", ""]
ORIENTATIONS = ["HeadFirstSupine", "HeadFirstProne", "FeetFirstSupine", "FeetFirstProne", "HeadFirstDecubitusLeft", "Sitting", "NoOrientation", None]
NOTE_LABELS = ["Lng", "Lat", "Vrt", "LONG", "lateral", "Vert", "Latx", "  lat"]
NOTE_GAPS = [": ", " fra dpl ", " - ", ":+", " −", "", " (sin) ", ": (dxt R) "]
NOTE_TAILS = ["cm", " mm", " MM (sin)", "", " cm (dxt)", "cm (Breast L) then 7", ",5cm", ".25 (none"]
RX_REGIONS = ["C", "Th", "L", "S", "T", "TH", "l", "Lumbar"]
STRUCTURE_IDS = ["PTV_Th9", "spinal_cord", "heart", "kidney_left", "kidney_right", "lung_left", "lung_right", "liver"]

_DIGITS = _values([(k,) for k in range(8)], "{0}(v)")

VIEWS = {
    "structure": f"""
        SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS patient_id, s.set_id, n.structure_id, p_size = 1 AS is_empty,
          CAST(p_partkey AS BIGINT) AS seq, CASE WHEN p_size % 10 = 3 THEN NULL ELSE 'FOR' || CAST(p_size % 3 AS VARCHAR(9)) END AS frame,
          CAST(p_size AS BIGINT) AS nx
        FROM {{part}}
        JOIN {_values(list(enumerate(SETS)), 's(k, set_id)')} ON s.k = p_partkey % 4
        JOIN {_values([(o, k, n) for o, row in enumerate(SPELLINGS) for k, n in enumerate(row)], 'n(o, k, structure_id)')}
          ON n.k = s.k AND n.o = CAST(floor(p_partkey / 4) AS BIGINT) % 10""",
    # up to three lines of every mix of label, gap, number and tail
    "note": f"""
        SELECT CAST(o_orderkey AS BIGINT) AS note_id, CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '' ELSE
          a.t || g.t || CAST(o_custkey % 40 AS VARCHAR(9)) || e.t || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE chr(10) || b.t || h.t || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE CAST(o_custkey % 23 AS VARCHAR(9)) END || f.t END
          || CASE WHEN o_orderkey % 5 < 3 THEN '' ELSE chr(10) || c.t || e.t || CAST(o_custkey % 9 AS VARCHAR(9)) END END AS note
        FROM {{orders}}
        JOIN {_values(list(enumerate(NOTE_LABELS)), 'a(k, t)')} ON a.k = o_orderkey % 8 JOIN {_values(list(enumerate(NOTE_LABELS)), 'b(k, t)')} ON b.k = CAST(floor(o_orderkey / 8) AS BIGINT) % 8
        JOIN {_values(list(enumerate(NOTE_LABELS)), 'c(k, t)')} ON c.k = CAST(floor(o_orderkey / 64) AS BIGINT) % 8 JOIN {_values(list(enumerate(NOTE_GAPS)), 'g(k, t)')} ON g.k = o_custkey % 8
        JOIN {_values(list(enumerate(NOTE_GAPS)), 'h(k, t)')} ON h.k = CAST(floor(o_custkey / 8) AS BIGINT) % 8 JOIN {_values(list(enumerate(NOTE_TAILS)), 'e(k, t)')} ON e.k = CAST(floor(o_orderkey / 5) AS BIGINT) % 8
        JOIN {_values(list(enumerate(NOTE_TAILS)), 'f(k, t)')} ON f.k = CAST(floor(o_orderkey / 11) AS BIGINT) % 8""",
    "plan": f"""
        SELECT CAST(o_orderkey AS BIGINT) AS plan_no, p.t || m.t || e.t AS plan_id, CASE WHEN o_orderkey % 13 > 0 THEN f.t || n.t || q.t END AS site, o.orientation FROM {{orders}}
        JOIN {_values(list(enumerate(LABEL_PARTS)), 'p(k, t)')} ON p.k = o_orderkey % 14 JOIN {_values(list(enumerate(LABEL_MARKS)), 'm(k, t)')} ON m.k = o_custkey % 6
        JOIN {_values(list(enumerate(LABEL_ENDS)), 'e(k, t)')} ON e.k = CAST(floor(o_orderkey / 14) AS BIGINT) % 14 JOIN {_values(list(enumerate(LABEL_ENDS)), 'f(k, t)')} ON f.k = CAST(floor(o_custkey / 3) AS BIGINT) % 14
        JOIN {_values(list(enumerate(LABEL_MARKS)), 'n(k, t)')} ON n.k = CAST(floor(o_orderkey / 3) AS BIGINT) % 6 JOIN {_values(list(enumerate(LABEL_PARTS)), 'q(k, t)')} ON q.k = CAST(floor(o_custkey / 5) AS BIGINT) % 14
        JOIN {_values(list(enumerate(ORIENTATIONS)), 'o(k, orientation)')} ON o.k = o_custkey % 8""",
    "beam": """
        SELECT CAST(l_orderkey AS BIGINT) AS plan_no, CAST(l_linenumber AS INTEGER) AS pos, l_linenumber % 3 = 1 AS is_setup,
          CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS lat_mm,
          CAST(CAST(floor(l_extendedprice) AS BIGINT) % 500 AS DOUBLE) AS lng_mm,
          CASE WHEN l_linenumber % 5 = 4 THEN CAST('NaN' AS DOUBLE) ELSE CAST(l_suppkey % 50 AS DOUBLE) END AS vrt_mm
        FROM {lineitem}""",
    "dose": f"""
        SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS plan_no, s.structure_id, CAST(l_quantity AS DOUBLE) * 9 / 50 * CASE WHEN l_linenumber % 2 = 0 THEN 100 ELSE 1 END AS dose,
          CASE WHEN l_linenumber % 2 = 0 THEN 'cGy' ELSE 'Gy' END AS unit
        FROM {{lineitem}} JOIN {_values(list(enumerate(STRUCTURE_IDS)), 's(k, structure_id)')} ON s.k = l_suppkey % 8""",
    # labels from every mix of two regions (some of them none), numbers (some past the region's end or padded) and spacing
    "rx": f"""
        SELECT CAST(o_custkey AS BIGINT) AS course, CAST(o_orderkey AS BIGINT) AS rx_id, CASE o_orderkey % 11
          WHEN 0 THEN r.w || m WHEN 1 THEN r.w || ' ' || m WHEN 2 THEN r.w || m || '-' || s.w || n WHEN 3 THEN r.w || m || ' - ' || s.w || ' ' || n WHEN 4 THEN r.w || ' ' || m || ' -' || n
          WHEN 5 THEN r.w || m || '-' || r.w || n || ' 8Gy x1' WHEN 6 THEN ' ' || r.w || m || ' 8Gy' WHEN 7 THEN r.w || m || '-8Gy' WHEN 8 THEN r.w || m || '_' || s.w || n
          WHEN 9 THEN r.w || m || ' - ' || r.w || m END AS label
        FROM (SELECT *, CAST(o_custkey % 14 AS VARCHAR(9)) AS m, CASE WHEN o_orderkey % 5 = 0 THEN '0' ELSE '' END || CAST(CAST(floor(o_orderkey / 7) AS BIGINT) % 13 AS VARCHAR(9)) AS n FROM {{orders}}) o
        JOIN {_values(list(enumerate(RX_REGIONS)), 'r(k, w)')} ON r.k = CAST(floor(o_orderkey / 3) AS BIGINT) % 8
        JOIN {_values(list(enumerate(RX_REGIONS)), 's(k, w)')} ON s.k = CAST(floor(o_orderkey / 5) AS BIGINT) % 8""",
    "plan_id": """
        SELECT CAST(o_custkey AS BIGINT) AS course, CAST(o_orderkey AS BIGINT) AS seq, CASE o_orderkey % 5
          WHEN 0 THEN 'MV' || CAST(o_orderkey % 37 AS VARCHAR(9)) || '_Th9_8' WHEN 1 THEN 'mv' || CAST(o_orderkey % 23 AS VARCHAR(9)) || '_L1_8'
          WHEN 2 THEN 'MV' || CAST(o_orderkey % 41 AS VARCHAR(9)) || ' kopi 1' WHEN 3 THEN 'Plan 7'
          ELSE 'MV1_L1-L4_8_' || CAST(o_orderkey AS VARCHAR(20)) END AS plan_id
        FROM {orders}""",
    "image": """
        SELECT CAST(user_id AS BIGINT) AS patient_id, CAST(event_id AS BIGINT) AS seq,
          CASE event_id % 3 WHEN 0 THEN 'kVCBCT_' WHEN 1 THEN 'img kvcbct ' ELSE 'CT_' END || CAST(event_id AS VARCHAR(20)) AS image_id,
          CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS created
        FROM {events}""",
    "mask": f"""
        SELECT CAST(p_partkey AS BIGINT) AS pair_id, r.role, CAST(x.v + p_partkey % 3 + r.k * (p_partkey % 2) AS INTEGER) AS x,
          CAST(y.v + p_partkey % 2 + r.k * (p_partkey % 3) AS INTEGER) AS y, CAST(z.v AS INTEGER) AS z
        FROM {{part}} JOIN {_values([(0, 'GT'), (1, 'AI')], 'r(k, role)')} ON NOT (r.k = 1 AND p_size = 1)
        JOIN {_DIGITS.format('x')} ON x.v < 2 + p_size % 3 + r.k JOIN {_DIGITS.format('y')} ON y.v < 2 + p_size % 2
        JOIN {_DIGITS.format('z')} ON z.v < 1 + p_size % 3""",
    # the voxels of each row of the view "structure", by its seq
    "structure_mask": f"""
        SELECT CAST(p_partkey AS BIGINT) AS handle, CAST(x.v + p_partkey % 3 AS INTEGER) AS x, CAST(y.v + p_partkey % 2 AS INTEGER) AS y, CAST(z.v AS INTEGER) AS z
        FROM {{part}} JOIN {_DIGITS.format('x')} ON x.v < 2 + p_size % 3 JOIN {_DIGITS.format('y')} ON y.v < 2 + p_size % 2
        JOIN {_DIGITS.format('z')} ON z.v < 1 + p_size % 3 WHERE p_size <> 1""",
    "mask_noise": """
        SELECT DISTINCT CAST(l_suppkey AS BIGINT) % 20 AS pair_id, CASE WHEN l_linenumber % 2 = 0 THEN 'GT' ELSE 'AI' END AS role, CAST(l_partkey % 16 AS INTEGER) AS x,
          CAST(l_orderkey % 16 AS INTEGER) AS y, CAST(CAST(l_quantity AS BIGINT) % 8 AS INTEGER) AS z
        FROM {lineitem}""",
    # a triangle and, inside of or beside it, a rectangle for each part
    "contour": """
        SELECT CAST(p_partkey AS BIGINT) AS pair_id, c.contour_no, c.vertex_no, CAST(c.px AS DOUBLE) + p_size % 4 + p_partkey % 10 / CAST(10 AS DOUBLE) AS px, CAST(c.py AS DOUBLE) * (1 + p_size % 3) + p_partkey % 4 / CAST(4 AS DOUBLE) AS py
        FROM {part} CROSS JOIN (VALUES (0, 0, 0, 0), (0, 1, 12, 1), (0, 2, 5, 9), (1, 0, 4, 2), (1, 1, 7, 2), (1, 2, 7, 4), (1, 3, 4, 4), (2, 0, 1, 1), (2, 1, 3, 3)) AS c(contour_no, vertex_no, px, py)""",
    "hu": """
        SELECT CAST(l_suppkey AS BIGINT) AS image, CAST(l_partkey % 16 AS INTEGER) AS x, CAST(l_orderkey % 16 AS INTEGER) AS y,
          CAST(CAST(l_quantity AS BIGINT) % 8 AS INTEGER) AS z, CAST(max(CAST(floor(l_extendedprice) AS BIGINT) % 2000) AS INTEGER) AS raw
        FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    "node": f"""
        SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS patient_id, CAST(p_partkey AS BIGINT) AS node, s.set_id, n.structure_id
        FROM {{part}}
        JOIN {_values(list(enumerate(SETS)), 's(k, set_id)')} ON s.k = p_partkey % 4
        JOIN {_values([(o, k, n) for o, row in enumerate(SPELLINGS) for k, n in enumerate(row)], 'n(o, k, structure_id)')}
          ON n.k = s.k AND n.o = CAST(floor(p_partkey / 4) AS BIGINT) % 10""",
    # a log of edits of each patient's links, among nine of its structures; some are refused or find nothing
    "link_edit": """
        SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS patient_id, CAST(p_partkey AS BIGINT) AS seq,
          CASE WHEN p_size % 10 < 5 THEN 'add' WHEN p_size % 10 < 7 THEN 'remove' WHEN p_size % 10 = 7 THEN 'auto' WHEN p_size % 10 = 8 THEN 'truth' WHEN p_partkey % 3 = 0 THEN 'clear' ELSE 'zoom' END AS op,
          CAST(p_partkey - p_partkey % 40 + p_partkey % 5 AS BIGINT) AS a, CAST(p_partkey - p_partkey % 40 + CAST(floor(p_size / 3) AS BIGINT) % 9 AS BIGINT) AS b,
          CASE p_size % 4 WHEN 0 THEN 'Manual' WHEN 1 THEN 'AutoContour1' WHEN 2 THEN 'TotalSegAuto' ELSE 'Replan' END AS set_id
        FROM {part}""",
    # candidates of a search that were evaluated, some of them twice
    "candidate": """
        SELECT CAST(l_orderkey AS BIGINT) AS plan_no, CAST(30 + 5 * (l_partkey % 27) AS DOUBLE) AS value, CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) END AS cost
        FROM {lineitem}""",
    # the user's own links, some of them useless (unknown end, same set, to itself)
    "manual_edge": """
        SELECT CAST(p_partkey AS BIGINT) AS a, CAST(p_partkey AS BIGINT) + CASE p_size % 4 WHEN 0 THEN 9 WHEN 1 THEN 4 WHEN 2 THEN 0 ELSE 11 END AS b
        FROM {part}""",
}


#: Views of voxels and points: the key that their rows are dealt by, as the view states it, and the most source rows of a task.
DEALT = {
    "mask": ("part", "CAST(p_partkey AS BIGINT)", 4_000), "structure_mask": ("part", "CAST(p_partkey AS BIGINT)", 4_000), "contour": ("part", "CAST(p_partkey AS BIGINT)", 4_000),
    "hu": ("lineitem", "CAST(l_suppkey AS BIGINT)", 100_000),
}


def deal(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Source rows placed by the view's key before the view multiplies or groups them, in as many tasks as they need.

    Voxels of a key are then made where they are worked on: what groups or joins by the key moves none of them, and a task's
    memory doesn't follow the table.
    """
    return placed(rows, [F.expr(key)], most)


def tasks_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """The number of tasks that a view of ``DEALT`` is dealt to, for what shall meet it without a shuffle."""
    source, _, most = DEALT[name]
    return tasks(spark.read.parquet(f"{sf_dir}/{source}.parquet"), most)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view over the tables below ``sf_dir``."""
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "orders", "lineitem", "events") if "{" + t + "}" in sql}
    if name in DEALT:
        source, key, most = DEALT[name]
        used[source] = deal(used[source], key, most)
    return spark.sql(sql, **used)


#: The grid of the views' images: turned by a right angle, so that no axis is that of the patient.
GRID = Grid((10.0, -20.0, 5.0), ((0.0, 1.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 0.0, 1.0)), (1.0, 1.5, 3.0), (16, 16, 8))


def handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``comparison.compare`` knows of each structure: handle, frame, image, segment and the mesh's box in mm.

    Some have no box, and some lie outside of the image.
    """
    own = gather(view(spark, sf_dir, "structure"))
    nx, seq = F.col("nx"), F.col("seq")
    away = F.when(nx % 17 == 0, 1000).otherwise(0)
    x0, y0 = seq % 3 + 0.25, seq % 2 + 0.25
    x1, y1 = seq % 3 + 0.75 + nx % 3, seq % 2 + 0.75 + nx % 2
    box = {"bx": 10 - y1 * 1.5, "by": x0 - 20 + away, "bz": F.lit(5.0), "sx": (y1 - y0) * 1.5, "sy": x1 - x0, "sz": nx % 3 * 3.0}
    bounds = [F.when(nx % 11 != 0, e).cast("double").alias(c) for c, e in box.items()]
    return own.select("patient_id", "set_id", "structure_id", seq.alias("handle"), "frame", (nx % 13 != 0).alias("has_image"), (nx % 7 != 0).alias("has_segment"), *bounds)


def view_sql(*names: str) -> str:
    """The same views as DuckDB common table expressions ``v_<name>``."""
    tables = {t: t for t in ("part", "orders", "lineitem", "events")}
    return "WITH " + ",\n".join(f"v_{n} AS ({VIEWS[n].format(**tables)})" for n in names)
