"""Prescriptions, required structures, ids and images of a planning run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoplane.functions.text import mv_number, vertebra_range, vertebra_segment

# Structures that are segmented in parts.
PARTS = {
    "lung_left": ["lung_upper_lobe_left", "lung_lower_lobe_left"],
    "lung_right": ["lung_upper_lobe_right", "lung_middle_lobe_right", "lung_lower_lobe_right"],
    "lung": ["lung_upper_lobe_left", "lung_lower_lobe_left", "lung_upper_lobe_right", "lung_middle_lobe_right", "lung_lower_lobe_right"],
}
#: Longest plan or structure id.
ID_LENGTH = 16


def prescriptions(rx: DataFrame) -> DataFrame:
    """The first prescription of each course and vertebra range: ``(course, rx_id, name, tokens, segments)``."""
    found = rx.withColumn("v", vertebra_range("label")).where("v is not null").select("course", "rx_id", "v.name", "v.tokens")
    first = Window.partitionBy("course", "name").orderBy("rx_id")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").withColumn("segments", F.transform("tokens", vertebra_segment))


def expand_parts(names: Column) -> Column:
    """Ordered distinct segment ids, mergeable structures replaced by their parts."""
    def parts(name: Column) -> Column:
        found = F.array(name)
        for whole, pieces in PARTS.items():
            found = F.when(name == whole, F.array(*[F.lit(p) for p in pieces])).otherwise(found)
        return found

    return F.array_distinct(F.flatten(F.transform(names, parts)))


def missing_required(required: DataFrame, structures: DataFrame) -> DataFrame:
    """Required ids that a set lacks or holds empty; ids compare without case, the first of equal ids counts."""
    first = Window.partitionBy("set_no", F.upper("structure_id")).orderBy("seq")
    own = structures.withColumn("n", F.row_number().over(first)).where("n = 1").select("set_no", F.upper("structure_id").alias("k"), "is_empty")
    met = required.withColumn("k", F.upper("structure_id")).join(own, ["set_no", "k"], "left")
    return met.where("is_empty is null or is_empty").select("set_no", "structure_id", F.when(F.col("is_empty").isNull(), "missing").otherwise("empty").alias("problem"))


def highest_mv(plans: DataFrame) -> DataFrame:
    """The highest running number of each course, 0 if there is none."""
    return plans.groupBy("course").agg(F.coalesce(F.max(mv_number("plan_id")), F.lit(0)).alias("highest"))


def lowest_mv(plans: DataFrame, default: Column) -> DataFrame:
    """The lowest positive running number of each course."""
    n = mv_number("plan_id")
    return plans.groupBy("course").agg(F.coalesce(F.min(F.when(n > 0, n)), default).alias("lowest"))


def plan_name(number: Column, name: Column) -> Column:
    return F.concat(F.lit("MV"), number.cast("string"), F.lit("_"), name, F.lit("_8"))


def target_names(name: Column) -> list[Column]:
    """CTV and PTV ids of a target; null where the id would be too long."""
    return [F.when(F.length(full) <= ID_LENGTH, full) for full in (F.concat(F.lit(p), name) for p in ("CTV_", "PTV_"))]


def number_new_plans(wanted: DataFrame, plans: DataFrame) -> DataFrame:
    """Ids of new plans: running numbers go on after the course's highest; copies take none and are left out here."""
    top = highest_mv(plans)
    order = Window.partitionBy("course").orderBy("rx_id")
    numbered = wanted.join(top, "course", "left").withColumn("n", F.coalesce("highest", F.lit(0)) + F.row_number().over(order))
    return numbered.select("course", "rx_id", plan_name(F.col("n"), F.col("name")).alias("plan_id")).where(F.length("plan_id") <= ID_LENGTH)


def free_copy_number(plans: DataFrame, base: Column, most: int = 999) -> DataFrame:
    """The smallest number from 1 on for which ``<base> kopi <n>`` is not taken in the course."""
    wanted = plans.select("course", base.alias("base")).distinct()
    # only the spelling that would be made is taken, in any case: "kopi 01" is not "kopi 1"
    copy = r"(?i)^(.*) kopi ([1-9][0-9]{0,2})$"
    n = F.regexp_extract("plan_id", copy, 2).try_cast("int")
    taken = plans.select("course", F.upper(F.regexp_extract("plan_id", copy, 1)).alias("k"), n.alias("n")).where("n is not null").distinct()
    # the first gap: the smallest n whose rank among the taken numbers is not itself
    rank = F.row_number().over(Window.partitionBy("course", "k").orderBy("n"))
    run = taken.withColumn("r", rank).groupBy("course", "k").agg(F.coalesce(F.max(F.when(F.col("n") == F.col("r"), F.col("n"))), F.lit(0)).alias("used"))
    met = wanted.withColumn("k", F.upper("base")).join(run, ["course", "k"], "left").withColumn("number", F.coalesce("used", F.lit(0)) + 1)
    return met.where(F.col("number") <= most).select("course", "base", "number")


def plan_ids(wanted: DataFrame, plans: DataFrame) -> DataFrame:
    """The id of each wanted plan ``(course, mv, name, target_id)``: the first plan of a target is named after it, the next
    ones are the next free copies of the lowest running number among the plans of that target (``mv`` where none has one)."""
    own = plans.select("course", F.upper("target_id").alias("t"), mv_number("plan_id").alias("n"))
    lowest = own.groupBy("course", "t").agg(F.min(F.when(F.col("n") > 0, F.col("n"))).alias("n"), F.count("*").alias("existing"))
    met = wanted.withColumn("t", F.upper("target_id")).join(lowest, ["course", "t"], "left")
    met = met.withColumn("base", F.concat(F.lit("MV"), F.coalesce("n", "mv").cast("string")))
    everything = plans.select("course", "plan_id", F.lit(None).cast("string").alias("base")).unionByName(met.select("course", F.lit(None).cast("string").alias("plan_id"), "base"))
    free = free_copy_number(everything, F.col("base")).where("base is not null")
    first = plan_name(F.col("mv"), F.col("name"))
    copy = F.concat("base", F.lit(" kopi "), F.col("number").cast("string"))
    found = met.join(free, ["course", "base"], "left").withColumn("plan_id", F.when(F.col("existing").isNull() | F.col("number").isNull(), first).otherwise(copy))
    return found.select(*wanted.columns, "plan_id")


def run_problem(reuse: Column, open_set: Column, open_image: Column, image: Column) -> Column:
    """Why a run cannot start on the structures already there; null if it can."""
    return F.when(reuse & open_set.isNull(), "no open structure set").when(reuse & ~open_image.eqNullSafe(image), "open structure set belongs to another image")


def newest_image(images: DataFrame, word: str = "kVCBCT") -> DataFrame:
    """Of each patient the newest image whose id holds ``word``; undated ones last, then the first scanned."""
    found = images.where(F.upper("image_id").contains(word.upper()))
    best = F.struct(F.col("created").isNull().alias("undated"), (-F.unix_micros(F.col("created").cast("timestamp"))).alias("age"), "seq")
    return found.groupBy("patient_id").agg(F.min_by(F.struct("image_id", "created"), best).alias("i")).select("patient_id", "i.*")


def resolve_image(*candidates: Column) -> Column:
    """The open image, else the set's, else the plan's."""
    return F.coalesce(*candidates)


def calculated_on_series(series: DataFrame, plans: DataFrame) -> DataFrame:
    """Series that have a calculated plan."""
    return series.join(plans.where("is_calculated").select("series_id"), "series_id", "left_semi")


def taken_reference_points(points: DataFrame) -> DataFrame:
    """Reference points whose id another plan of the course uses too."""
    used = points.groupBy("course", "point_id").agg(F.count_distinct("plan_id").alias("n")).where("n > 1").drop("n")
    return points.join(used, ["course", "point_id"], "left_semi")


def structure_action(existing: Column, writable: Column) -> Column:
    """Create a structure, reuse the one there, or create it under a suffix."""
    return F.when(existing.isNull(), "create").when(writable, "reuse").otherwise("create _ny")


def replace_copies(structures: DataFrame, copies: DataFrame, key: list[str]) -> DataFrame:
    """Structures with ``copies`` put in, each replacing the one of its key."""
    return structures.join(copies.select(*key), key, "left_anti").unionByName(copies)


def first_fractionation(plans: DataFrame, targets: DataFrame) -> DataFrame:
    """Plans with fractions and dose per fraction of the first target of their prescription."""
    first = targets.groupBy("rx_id").agg(F.min_by(F.struct("fractions", "dose_per_fraction"), "pos").alias("t"))
    return plans.join(first, "rx_id", "left").select(*plans.columns, "t.fractions", "t.dose_per_fraction")


def sets_of_series(sets: DataFrame, images: DataFrame, series_id: str) -> DataFrame:
    """Structure sets drawn on an image of the series."""
    return sets.join(images.where(F.col("series_id") == series_id).select("image_id"), "image_id", "left_semi")


def plans_in_scope(plans: DataFrame) -> DataFrame:
    """The plans in scope (``in_scope``) of each context; where there are none, its active plan (``is_active``)."""
    any_scope = F.max("in_scope").over(Window.partitionBy("context"))
    return plans.withColumn("any_scope", F.coalesce(any_scope, F.lit(False))).where("in_scope or (not any_scope and is_active)").drop("any_scope")


def prescription_rows(courses: DataFrame) -> DataFrame:
    """One row for each prescription of courses whose phases hold arrays of prescriptions."""
    phases = courses.select("course_id", F.explode("phases").alias("phase"))
    return phases.select("course_id", "phase.phase_id", F.explode("phase.prescriptions").alias("rx")).select("course_id", "phase_id", "rx.*")


def plans_of_target(plans: DataFrame, targets: DataFrame) -> DataFrame:
    """Plans that already treat one of the targets; ids compare without case."""
    return plans.withColumn("k", F.upper("target_id")).join(targets.select(F.upper("target_id").alias("k")).distinct(), "k", "left_semi").drop("k")


def with_colours(structures: DataFrame, colours: DataFrame) -> DataFrame:
    """Structures with a display colour where the table has one."""
    return structures.join(colours, "structure_id", "left")


def models_available(models: Column, needed: list[str]) -> Column:
    """Whether a machine has all calculation models."""
    return F.array_size(F.array_except(F.array(*[F.lit(m) for m in needed]), F.coalesce(models, F.array().cast("array<string>")))) == 0


def display_label(set_id: Column, image_id: Column) -> Column:
    """How a set is shown in a list."""
    return F.format_string("%s  (%s)", set_id, image_id)
