"""The comparison of matched structures: notes for the pairs that cannot be measured, metrics for the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoplane.checkpoints import cut

from .matching import NO_VOXELS, VOXEL_CAP, eligibility_note
from .voxels import Grid, oriented_box, overlap, surface_metrics

METRICS = ["dice", "jaccard", "hausdorff_mm", "hd95_mm", "assd_mm", "volume_gt_cc", "volume_ai_cc", "volume_diff_cc", "com_diff_mm"]


def compare(rows: DataFrame, structures: DataFrame, masks: DataFrame, grid: Grid, cap: int = VOXEL_CAP) -> DataFrame:
    """``rows`` (of ``auto_match``, or of ``pair_match`` under the same names) with ``METRICS`` and the final ``note``.

    ``structures`` has one row for each ``(patient_id, set_id, structure_id)`` with ``handle``, ``frame``, ``has_image``,
    ``has_segment`` and the mesh's box in mm, ``bx, by, bz`` and its extent ``sx, sy, sz`` (null: no bounds); ``masks`` has
    ``(handle, x, y, z)`` on the ground truth's ``grid``.  A pair's box is the union of both, each clamped to the image, padded
    by a voxel and clamped again; pairs over ``cap`` voxels are noted.  Only masks of measured pairs move.
    """
    bounds = [f"{c}{k}" for c in "xyz" for k in (0, 1)]
    box, inside = oriented_box([F.col(f"b{c}") for c in "xyz"], [F.col(f"s{c}") for c in "xyz"], grid)
    structures = structures.select("patient_id", "set_id", "structure_id", "handle", "frame", "has_image", "has_segment", inside.alias("inside"), *[box[c].alias(c) for c in bounds])

    def side(name: str) -> DataFrame:
        found = F.struct("handle", "frame", "has_image", "has_segment", "inside", *bounds)
        return structures.select("patient_id", F.col("set_id").alias(f"{name}_set"), F.col("structure_id").alias(f"{name}_structure"), found.alias(name))

    met = rows
    for name in ("gt", "ai"):
        met = met.join(side(name), ["patient_id", f"{name}_set", f"{name}_structure"], "left")

    def length(axis: str, n: int):
        low = F.greatest(F.least(f"gt.{axis}0", f"ai.{axis}0") - 1, F.lit(0))
        high = F.least(F.greatest(f"gt.{axis}1", f"ai.{axis}1") + 1, F.lit(n - 1))
        return F.greatest(high - low + 1, F.lit(0)).cast("long")

    both = lambda test: reduce(lambda a, b: a & b, [test(n) for n in ("gt", "ai")])
    voxels = reduce(lambda a, b: a * b, [length(c, n) for c, n in zip("xyz", grid.size)])
    why = eligibility_note(
        both(lambda n: F.col(n).isNotNull()), F.col("gt.has_image"), F.col("gt.frame"), F.col("ai.frame"),
        both(lambda n: F.col(f"{n}.has_segment")), both(lambda n: F.col(f"{n}.inside")), voxels, F.lit(True), cap,
    )
    met = met.withColumn("note", F.coalesce("note", why)).withColumn("gt_handle", F.col("gt.handle")).withColumn("ai_handle", F.col("ai.handle")).drop("gt", "ai")
    pairs = met.where("note is null").select("gt_handle", "ai_handle").distinct()
    roles = [pairs.withColumn("handle", F.col(c)).join(masks, "handle").select("gt_handle", "ai_handle", F.lit(r).alias("role"), "x", "y", "z") for c, r in (("gt_handle", "GT"), ("ai_handle", "AI"))]
    mask = cut(roles[0].unionByName(roles[1]))  # read by every metric
    measured = overlap(mask, ["gt_handle", "ai_handle"], grid.spacing).drop("cg", "ca", "note").join(surface_metrics(mask, ["gt_handle", "ai_handle"], grid.spacing), ["gt_handle", "ai_handle"], "left")
    out = met.join(measured, ["gt_handle", "ai_handle"], "left")
    note = F.when(F.col("note").isNull() & F.col("dice").isNull(), NO_VOXELS).otherwise(F.col("note"))
    return out.select(*[c for c in rows.columns if c != "note"], *METRICS, note.alias("note"))
