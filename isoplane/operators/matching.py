"""Matching structures of different contouring methods by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoplane.functions.text import organ_key

#: Largest box, in voxels, that a comparison may have.
VOXEL_CAP = 25_000_000
# Why a pair is not measured.
NO_TRUTH = "no ground-truth structure in this group"
NO_HANDLE = "structure handle missing"
NO_IMAGE = "ground-truth set has no image to rasterize on"
OTHER_FRAME = "ground truth and AI are in different frames of reference"
NO_SEGMENT = "empty structure (no segment)"
NO_BOUNDS = "no mesh geometry / bounds unavailable"
DEGENERATE = "degenerate bounding box"
TOO_LARGE = "structure too large (%s voxels)"
NO_VOXELS = "empty structure (no voxels)"


def ordinal(*names: str) -> list[Column]:
    """Ordering that ignores case by folding to upper, with the raw text as the last word."""
    return [x for n in names for x in (F.upper(n), F.col(n))]


def gather(structures: DataFrame) -> DataFrame:
    """One row for each patient, set and structure; of repeated ones the last scanned (``seq``) counts."""
    last = Window.partitionBy("patient_id", "set_id", "structure_id").orderBy(F.desc("seq"))
    return structures.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def role(set_id: str = "set_id") -> Column:
    """AI for sets whose name holds *auto*, else GroundTruth."""
    return F.when(F.upper(set_id).contains("AUTO"), "AI").otherwise("GroundTruth")


def match_groups(structures: DataFrame) -> DataFrame:
    """Members ``(patient_id, match_key, set_id, structure_id, is_empty, role, group_no, member_no)`` of all groups.

    A group is a key that at least two sets of a patient have.  Groups are numbered per patient in key order, before any
    of them is dropped; ground truth comes first within a group.
    """
    keyed = structures.withColumn("match_key", organ_key("structure_id")).where("match_key is not null").withColumn("role", role())
    sets = F.size(F.collect_set("set_id").over(Window.partitionBy("patient_id", "match_key")))
    kept = keyed.withColumn("sets", sets).where("sets >= 2")
    number = F.dense_rank().over(Window.partitionBy("patient_id").orderBy(*ordinal("match_key")))
    member = Window.partitionBy("patient_id", "match_key").orderBy((F.col("role") != "GroundTruth").cast("int"), *ordinal("set_id", "structure_id"))
    return kept.withColumn("group_no", number).withColumn("member_no", F.row_number().over(member)).drop("sets")


def auto_match(structures: DataFrame) -> DataFrame:
    """Comparison rows: the first ground truth of a group against each of its AI members; AI alone gets a note."""
    members = match_groups(gather(structures))
    first = members.where("role = 'GroundTruth'").select(
        "patient_id", "match_key", F.col("set_id").alias("gt_set"), F.col("structure_id").alias("gt_structure"), F.col("is_empty").alias("gt_empty"), "member_no"
    )
    first = first.where("member_no = 1").drop("member_no")
    ai = members.where("role = 'AI'").select(
        "patient_id", "match_key", "group_no", F.col("set_id").alias("ai_set"), F.col("structure_id").alias("ai_structure"), F.col("is_empty").alias("ai_empty")
    )
    return ai.join(first, ["patient_id", "match_key"], "left").withColumn("note", F.when(F.col("gt_set").isNull(), NO_TRUTH))


def ground_truth_warning(structures: DataFrame) -> DataFrame:
    """Per patient the ground-truth sets, and a warning unless there is exactly one."""
    sets = structures.select("patient_id", "set_id").distinct().where(role() == "GroundTruth")
    found = sets.groupBy("patient_id").agg(F.count("*").alias("n_sets"), F.array_join(F.array_sort(F.collect_list("set_id")), ", ").alias("sets"))
    everyone = structures.select("patient_id").distinct().join(found, "patient_id", "left")
    n = F.coalesce("n_sets", F.lit(0))
    return everyone.select("patient_id", n.alias("n_sets"), F.coalesce("sets", F.lit("")).alias("sets"), F.when(n == 0, "none").when(n > 1, "several").otherwise("").alias("warning"))


def pair_match(structures: DataFrame, reference: str, compared: str, skip_body: bool = False) -> DataFrame:
    """Organs that two chosen sets share; of equal keys in a set the first in id order counts."""
    if reference == compared:
        raise ValueError("a set cannot be compared with itself")
    keyed = gather(structures).withColumn("match_key", organ_key("structure_id")).where("match_key is not null")
    if skip_body:
        keyed = keyed.where(F.upper(F.trim("structure_id")) != "BODY")
    first = Window.partitionBy("patient_id", "set_id", "match_key").orderBy(*ordinal("structure_id"))
    keyed = keyed.where(F.col("set_id").isin(reference, compared)).withColumn("n", F.row_number().over(first)).where("n = 1")

    def side(set_id: str, name: str) -> DataFrame:
        return keyed.where(F.col("set_id") == set_id).select("patient_id", "match_key", F.col("structure_id").alias(f"{name}_structure"))

    return side(reference, "gt").join(side(compared, "cmp"), ["patient_id", "match_key"])


def eligibility_note(has_handle: Column, has_image: Column, gt_frame: Column, ai_frame: Column, has_segment: Column, has_bounds: Column, voxels: Column, filled: Column, cap: int = VOXEL_CAP) -> Column:
    """The first reason, in order of testing, why a pair is not measured; null if it can be."""
    return (
        F.when(~has_handle, NO_HANDLE)
        .when(~has_image, NO_IMAGE)
        .when(~(gt_frame == ai_frame) | gt_frame.isNull() | ai_frame.isNull(), OTHER_FRAME)
        .when(~has_segment, NO_SEGMENT)
        .when(~has_bounds, NO_BOUNDS)
        .when(voxels <= 0, DEGENERATE)
        .when(voxels > cap, F.format_string(TOO_LARGE, F.format_number(voxels.cast("long"), 0)))
        .when(~filled, NO_VOXELS)
    )
