"""Views place their rows by key in as many tasks as the source needs; what follows moves no voxel."""

import pytest
from pyspark.sql import functions as F

from isoplane.operators import voxels
from isoplane.plans import catalogue
from isoplane.sources import views

SF = "/root/testdata/sf0.01"


def test_tasks_follow_the_source(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet")
    assert views.deal(parts, "CAST(p_partkey AS BIGINT)", 20).rdd.getNumPartitions() == -(-parts.count() // 20)


@pytest.mark.parametrize("name", ["overlap", "border", "mask_set_operations", "polygon_erase", "polygon_fill", "close_z", "outline", "margin_shrink", "close_2d"])
def test_no_voxel_moves(spark, name):
    plan = catalogue.QUERIES["q_" + name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moves and all("REPARTITION_BY_NUM" in line for line in moves)


def test_subtract_keeps_repeats_nulls_and_columns(spark):
    a = spark.createDataFrame([(1, 0, 0, 0, "p"), (1, 0, 0, 0, "q"), (1, 1, 0, 0, "r"), (1, 1, 0, 0, "r"), (None, 0, 0, 0, "s"), (2, None, 0, 0, "t")], "k int, x int, y int, z int, note string")
    b = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 0), (None, 0, 0, 0), (2, None, 0, 0), (2, 3_000_000_000, 0, 0), (9, 9, 9, 9)], "k long, x long, y long, z long")
    got = voxels.subtract(a, b, ["k"])
    assert got.schema == a.schema and sorted(r.note for r in got.collect()) == ["r", "r", "s", "t"]
    assert voxels.subtract(a, b.limit(0), ["k"]).agg(F.count("*")).first()[0] == 6


def test_fixation_is_the_same_when_its_steps_are_dealt(spark):
    spots = [(1, x, y, z, 1000 + (7 * x + 11 * y + 13 * z) % 990) for x in range(16) for y in range(16) for z in range(8)]
    hu = spark.createDataFrame(spots, "image int, x int, y int, z int, raw int")
    body, couch = hu.where("x between 5 and 9 and y between 3 and 6 and z between 2 and 5"), hu.where("y >= 14")
    run = lambda tasks: voxels.fixation(hu, body, couch, ["image"], (16, 16, 8), (1.0, 1.5, 3.0), F.lit(1950), F.lit(1850), 3, 2, 1.5, True, tasks=tasks)
    assert sorted(run(None).collect()) == sorted(run(3).collect())


@pytest.mark.parametrize("name", ["directed_dist", "contours_filled"])
def test_only_dealing_moves_rows(spark, name):
    plan = catalogue.QUERIES["q_" + name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange" in line]
    assert moves and all("REPARTITION_BY_NUM" in line for line in moves)
