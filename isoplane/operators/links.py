"""Link graphs between structures of different sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoplane.functions.text import link_key

from .labelling import components_by_key
from .matching import ordinal


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected edges ``(a, b)``, a < b, once each; nulls, unknown ends and links within a set or to itself are refused."""
    known = nodes.select("node", "set_id", "patient_id")
    end = lambda e: known.select(F.col("node").alias(e), F.col("set_id").alias(f"set_{e}"), F.col("patient_id").alias(f"patient_{e}"))
    met = edges.join(end("a"), "a").join(end("b"), "b").where("a <> b and set_a <> set_b and patient_a = patient_b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def auto_links(nodes: DataFrame) -> DataFrame:
    """A chain through the first structure of each set that has a name, in set order."""
    named = nodes.withColumn("name", link_key("structure_id")).where("name <> ''")
    first = Window.partitionBy("patient_id", "name", "set_id").orderBy("node")
    chain = Window.partitionBy("patient_id", "name").orderBy(*ordinal("set_id"), "node")
    one = named.withColumn("n", F.row_number().over(first)).where("n = 1")
    return one.withColumn("a", F.lag("node").over(chain)).where("a is not null").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))


def new_links(existing: DataFrame, links: DataFrame) -> DataFrame:
    """The links that are not there yet."""
    return links.join(existing.select("a", "b"), ["a", "b"], "left_anti")


def remove_links(existing: DataFrame, removed: DataFrame) -> DataFrame:
    """The links without those removed, in whichever direction they are named."""
    gone = removed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return existing.join(gone, ["a", "b"], "left_anti")


def link_groups(nodes: DataFrame, links: DataFrame, ground_truth: str | None = None, with_single: bool = False) -> DataFrame:
    """Linked groups, numbered per patient: the largest first, then by the first set and structure.

    Rows ``(patient_id, group_no, member_no, role, set_id, structure_id, node, size)``; a group's ground-truth member
    comes first, the others in set order.
    """
    # links stay within a patient, so its groups are found in one task
    owned = links.join(nodes.select(F.col("node").alias("a"), "patient_id"), "a")
    roots = components_by_key(owned, ["patient_id"]).select("node", "root")
    member = nodes.join(roots, "node", "left" if with_single else "inner").withColumn("root", F.coalesce("root", "node"))
    group = Window.partitionBy("patient_id", "root")
    order = group.orderBy(*ordinal("set_id", "structure_id"), "node")
    placed = member.withColumn("size", F.count("*").over(group)).withColumn("first", F.first(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ordinal("set_id", "structure_id"))])).over(order))
    numbered = placed.withColumn("group_no", F.dense_rank().over(Window.partitionBy("patient_id").orderBy(F.desc("size"), "first", "root")))
    is_truth = F.coalesce(F.col("set_id") == F.lit(ground_truth), F.lit(False))
    inner = Window.partitionBy("patient_id", "root").orderBy((~is_truth).cast("int"), *ordinal("set_id"), *ordinal("structure_id"), "node")
    return numbered.select(
        "patient_id", "group_no", F.row_number().over(inner).alias("member_no"), F.when(is_truth, "GroundTruth").otherwise("Compare").alias("role"), "set_id", "structure_id", "node", "size"
    )


def replay(nodes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links ``(patient_id, a, b, manual)`` and ground truths ``(patient_id, ground_truth)`` that a log of edits leaves.

    ``edits`` has ``(patient_id, seq, op, a, b, set_id)``: *add* links two nodes by hand, *auto* links all equal names,
    *remove* takes a link away, *clear* all of a patient's, *truth* chooses a set; other ops, and links that are refused (see
    ``valid_edges``), change nothing.  A link that is there already stays what it was, so its first addition after it last went
    decides whether it is manual.  That makes the replay a comparison of sequence numbers instead of a loop: a link is there
    if it was added after its last removal and its patient's last clearing.  ``seq`` is unique in a patient.
    """
    own = nodes.select("patient_id", F.col("node").alias("a"))
    by_hand = edits.where("op = 'add'").select("patient_id", "seq", "a", "b")
    valid = valid_edges(nodes, by_hand.select("a", "b").distinct())
    ordered = by_hand.select("patient_id", "seq", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(valid, ["a", "b"], "left_semi").join(own, ["patient_id", "a"], "left_semi")
    chains = auto_links(nodes).join(own, "a")
    named = edits.where("op = 'auto'").select("patient_id", "seq").join(chains, "patient_id").select("patient_id", "seq", "a", "b")
    added = ordered.withColumn("manual", F.lit(True)).unionByName(named.withColumn("manual", F.lit(False)))
    gone = edits.where("op = 'remove'").groupBy("patient_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("seq").alias("gone"))
    cleared = edits.where("op = 'clear'").groupBy("patient_id").agg(F.max("seq").alias("cleared"))
    met = added.join(gone, ["patient_id", "a", "b"], "left").join(cleared, "patient_id", "left")
    standing = met.where("(gone is null or seq > gone) and (cleared is null or seq > cleared)")
    kept = standing.groupBy("patient_id", "a", "b").agg(F.min_by("manual", "seq").alias("manual"))
    truths = edits.where("op = 'truth'").groupBy("patient_id").agg(F.max_by("set_id", "seq").alias("ground_truth"))
    return kept, truths


def link_counts(manual: DataFrame, automatic: DataFrame) -> DataFrame:
    """Numbers of manual and of automatic links; a link that is both counts as manual."""
    every = manual.select("a", "b", F.lit(True).alias("manual")).unionByName(new_links(manual, automatic).select("a", "b", F.lit(False).alias("manual")))
    return every.agg(F.count_if("manual").alias("n_manual"), F.count_if(~F.col("manual")).alias("n_auto"))
