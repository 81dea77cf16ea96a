"""Decision tables of the plan checks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def side_verdict(plan: Column, rx: Column) -> Column:
    """OK or WARNING for the sides of plan and prescription."""
    return (
        F.when((plan == "AMBIGUOUS") | (rx == "AMBIGUOUS"), "WARNING")
        .when((plan == "NONE") & (rx == "NONE"), "OK")
        .when((plan == "NONE") | (rx == "NONE"), "WARNING")
        .when(plan == rx, "OK")
        .otherwise("WARNING")
    )


def treated_side(plan: Column, rx: Column) -> Column:
    return F.when(plan != "NONE", plan).otherwise(rx)


def has_lateral_axis(orientation: Column) -> Column:
    """Whether left and right map to the couch's lateral axis."""
    return ~(orientation.contains("Decubitus") | orientation.isin("Sitting", "NoOrientation"))


def implied_side(lat: Column, orientation: Column) -> Column:
    """The side a signed lateral shift points to: prone and feet-first each turn it round."""
    flipped = orientation.contains("Prone") != orientation.startswith("FeetFirst")
    return F.when((lat > 0) == ~flipped, "RIGHT").otherwise("LEFT")


def lateral_check(treated: Column, lat: Column, orientation: Column, annotation: Column) -> Column:
    """Status of a lateral shift, by the first rule that applies."""
    implied = implied_side(lat, orientation)
    contradicts = annotation.isin("LEFT", "RIGHT") & (annotation != implied)
    return (
        F.when(treated == "NONE", "OK")
        .when(treated == "AMBIGUOUS", "INCONCLUSIVE")
        .when(lat.isNull(), "INCONCLUSIVE")
        .when(orientation.isNull(), "INCONCLUSIVE")
        .when(~has_lateral_axis(orientation), "INCONCLUSIVE")
        .when(F.abs(lat) < 1e-9, "WARNING")
        .when((implied == treated) & ~contradicts, "OK")
        .otherwise("WARNING")
    )


def vertical_check(vrt: Column, breast: Column) -> Column:
    return F.when(~breast, "OK").when(vrt.isNull(), "INCONCLUSIVE").when(vrt > 0, "OK").otherwise("WARNING")


def orientation_differs(plan: Column, image: Column) -> Column:
    return F.coalesce(plan != image, F.lit(False))


def beam_delta(beams: DataFrame) -> DataFrame:
    """Treatment beams with their distance from the plan's first setup field; missing if either side is null or NaN."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    axes = ("lat_mm", "lng_mm", "vrt_mm")
    first = beams.where("is_setup").groupBy("plan_no").agg(F.min_by(F.struct(*[known(c).alias(c) for c in axes]), F.struct("pos", *axes)).alias("ref"))
    met = beams.where(~F.col("is_setup")).join(first, "plan_no")
    return met.select("plan_no", "pos", *[(known(c) - F.col(f"ref.{c}")).alias(f"d_{c}") for c in axes])


def beams_in_order(beams: DataFrame) -> DataFrame:
    """Beams with setup fields first, otherwise in their own order: adds ``place``."""
    return beams.withColumn("place", F.row_number().over(Window.partitionBy("plan_no").orderBy(F.desc("is_setup"), "pos")))


def dose_gy(dose: Column, unit: Column) -> Column:
    """Dose in Gy; percentages have no meaning here and become null."""
    return F.when(unit == "Gy", dose).when(unit == "cGy", dose / 100)


def normalisation(value: Column, mean: Column, prescription: Column) -> Column:
    """The plan's normalisation value that brings the mean to the prescription; null where it cannot be set."""
    base = F.coalesce(F.when(~F.isnan(value), value), F.lit(100.0))
    return F.when((mean > 0) & (prescription > 0), base * mean / prescription)


def isocentre_shift(has_cord: Column, surface: Column, centre: Column, extra: float = 10.0, most: float = 60.0) -> Column:
    """How far the isocentre moves behind the cord's surface: nothing without cord or surface or forwards, at most ``most``."""
    shift = surface + extra - centre
    return F.when(~has_cord | surface.isNull() | (shift <= 0), 0.0).when(shift > most, most).otherwise(shift)


def jaw_clamp(x1: Column, x2: Column, most: float = 170.0) -> Column:
    """Jaw positions, drawn in about their centre where they are more than ``most`` apart."""
    mid = (x1 + x2) / 2
    wide = x2 - x1 > most
    return F.struct(F.when(wide, mid - most / 2).otherwise(x1).alias("x1"), F.when(wide, mid + most / 2).otherwise(x2).alias("x2"))


def wrap_angle(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def pair_angles(hinge: Column) -> Column:
    """Gantry angles of a pair of fields with a hinge angle, about 180 degrees."""
    return F.struct(wrap_angle(180 - hinge / 2).alias("first"), wrap_angle(180 + hinge / 2).alias("second"))


def meterset_ramp(points: int = 178) -> Column:
    """Cumulative meterset weights of an arc's control points."""
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / F.lit(points - 1))


# Arcs and fields of each technique (gantry start and stop, direction, collimator).
BEAMS = {
    "SingleArc": [(181.0, 179.0, "CW", 30.0)],
    "DualArc": [(181.0, 179.0, "CW", 30.0), (179.0, 181.0, "CCW", 330.0)],
    "ApPa": [(180.0, 180.0, "NONE", 0.0), (0.0, 0.0, "NONE", 0.0)],
}


def beam_table(technique: Column) -> Column:
    """Array of the beams of a technique; a static pair has a hinge and no fixed angles, so it is empty here."""
    beam = "array<struct<start:double,stop:double,direction:string,collimator:double>>"
    found = F.from_json(F.lit("[]"), beam)
    for name, rows in BEAMS.items():
        literal = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(d).alias("direction"), F.lit(c).alias("collimator")) for a, b, d, c in rows])
        found = F.when(technique == name, literal).otherwise(found)
    return found


# The beams of each planning technique; any other technique is a single arc.
TECHNIQUES = {"VmatDualArc": "DualArc", "ApPaPair": "ApPa"}


def plan_beams(technique: Column, hinge: Column) -> Column:
    """Array of the beams that a technique is built with: a static pair stands about the back at its hinge angle."""
    angles = pair_angles(hinge)
    static = F.array(*[F.struct(angles[k].alias("start"), angles[k].alias("stop"), F.lit("NONE").alias("direction"), F.lit(0.0).alias("collimator")) for k in ("first", "second")])
    table = F.lit("SingleArc")
    for name, beams in TECHNIQUES.items():
        table = F.when(technique == name, beams).otherwise(table)
    return F.when(technique == "StaticPair", static).otherwise(beam_table(table))


def reference_point_decision(current: Column, wanted: Column, taken: Column, primary: Column, plan_named: Column, only: Column) -> Column:
    """Which reference point a plan's dose point is named after: already right, refused, or the first candidate there is."""
    return (
        F.when(current == wanted, "already").when(taken, "taken").when(primary.isNotNull(), "primary").when(plan_named.isNotNull(), "plan-named")
        .when(only.isNotNull(), "only").otherwise("none")
    )


def rename_set(sets: DataFrame, old: str, new: str, locked: Column | None = None) -> DataFrame:
    """Sets with ``new_id`` and ``error``: too long, locked and duplicate names are reported, not raised."""
    locked = F.lit(False) if locked is None else locked
    same = F.max(F.upper("set_id") == F.lit(new.upper())).over(Window.partitionBy("patient_id"))
    hit = F.col("set_id") == old
    error = F.when(hit & F.lit(len(new) > 16), "name too long").when(hit & locked, "locked").when(hit & same & F.lit(old.upper() != new.upper()), "duplicate name")
    return sets.withColumn("error", error).withColumn("new_id", F.when(hit & error.isNull(), new).otherwise(F.col("set_id")))
