"""Delimited exports and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoplane.functions.text import export_field, number_text
from isoplane.operators.matching import ordinal

_METRICS = "DICE;Jaccard;Hausdorff_mm;HD95_mm;ASSD_mm;Volume_GT_cc;{}_cc;VolumeDiff_cc;COMdiff_mm;Note"
# The headers of the three exports.
AUTO_HEADER = "Group;MatchKey;GroundTruthSet;GroundTruthStructure;AiSet;AiStructure;" + _METRICS.format("Volume_AI")
PAIR_HEADER = "MatchKey;GroundTruthSet;GroundTruthStructure;CompareSet;CompareStructure;" + _METRICS.format("Volume_Cmp")
LINK_HEADER = "Group;Role;StructureSetId;StructureId"


def lines(df: DataFrame, columns: list[str]) -> Column:
    """One exported line: numbers with up to four decimals, semicolons in text replaced, no quoting."""
    kinds = dict(df.dtypes)
    return F.concat_ws(";", *[number_text(c) if kinds[c] in ("double", "float") else export_field(F.col(c).cast("string")) for c in columns])


def write_csv(df: DataFrame, path: str, header: str, columns: list[str], order: list[Column]) -> None:
    """A UTF-8 file with byte-order mark and CRLF line ends, below the folder ``path``; refuses an empty export.

    An export is one ordered file for people to read, so its last stage is one task; Spark streams it row by row.
    """
    if df.isEmpty():
        raise ValueError("nothing to export")
    body = df.orderBy(*order).select(lines(df, columns).alias("value")).coalesce(1)
    head = df.sparkSession.range(1).select(F.lit("﻿" + header).alias("value"))
    head.coalesce(1).unionByName(body).coalesce(1).write.option("lineSep", "\r\n").text(path)


LINK_COLUMNS = ["group_no", "role", "set_id", "structure_id"]
METRIC_COLUMNS = ["dice", "jaccard", "hausdorff_mm", "hd95_mm", "assd_mm", "volume_gt_cc", "volume_ai_cc", "volume_diff_cc", "com_diff_mm", "note"]


AUTO_COLUMNS = ["group_no", "match_key", "gt_set", "gt_structure", "ai_set", "ai_structure", *METRIC_COLUMNS]


def write_auto_csv(rows: DataFrame, path: str) -> None:
    """Rows of ``auto_match`` with metrics, 16 columns, in group order."""
    write_csv(rows, path, AUTO_HEADER, AUTO_COLUMNS, [F.col("group_no"), *ordinal("ai_set", "ai_structure")])


def write_pair_csv(rows: DataFrame, path: str, gt_set: str, cmp_set: str) -> None:
    """Rows of ``pair_match`` with metrics, 15 columns, in key order."""
    named = rows.withColumn("gt_set", F.lit(gt_set)).withColumn("cmp_set", F.lit(cmp_set))
    write_csv(named, path, PAIR_HEADER, ["match_key", "gt_set", "gt_structure", "cmp_set", "cmp_structure", *METRIC_COLUMNS], ordinal("match_key"))


def write_link_csv(groups: DataFrame, path: str) -> None:
    """Rows of ``link_groups``, ground truth first in each group."""
    write_csv(groups, path, LINK_HEADER, LINK_COLUMNS, [F.col("group_no"), F.col("member_no")])


def report(rows: DataFrame) -> DataFrame:
    """One text for each group of compared rows: a title, and for each row the pair with its metrics or its note.

    Numbers have up to three decimals; rows come in the order of the automatic structure, whatever its case.
    """
    shown = lambda m: number_text(m, 3, "n/a")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    truth = F.when(F.coalesce("gt_structure", F.lit("")) == "", "(no GT)").otherwise(join(F.col("gt_set"), ":", F.col("gt_structure")))
    pair = join("     GT ", truth, "   vs   AI ", F.col("ai_set"), ":", F.col("ai_structure"))
    agreement = join("        DICE ", shown("dice"), "  Jaccard ", shown("jaccard"), "  HD ", shown("hausdorff_mm"), "mm  HD95 ", shown("hd95_mm"), "mm  ASSD ", shown("assd_mm"), "mm")
    volumes = join("        Vol GT/AI ", shown("volume_gt_cc"), "/", shown("volume_ai_cc"), " cc  (diff ", shown("volume_diff_cc"), " cc)  COM diff ", shown("com_diff_mm"), " mm")
    text = F.concat_ws("\n", pair, F.when(F.col("note").isNull(), F.concat_ws("\n", agreement, volumes)).otherwise(join("        — ", F.col("note"))))
    order = [F.upper("ai_set").alias("a"), F.col("ai_set").alias("b"), F.upper("ai_structure").alias("c"), F.col("ai_structure").alias("d")]
    found = rows.groupBy("patient_id", "group_no", "match_key").agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("text")))).alias("rows"))
    title = join("[", F.col("group_no").cast("string"), "] ", F.col("match_key"))
    return found.select("patient_id", "group_no", F.array_join(F.concat(F.array(title), F.transform("rows", lambda r: r["text"])), "\n").alias("report"))
