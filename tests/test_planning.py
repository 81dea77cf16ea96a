from pyspark.sql import functions as F

from isoplane import timing
from isoplane.operators import planning as P
from isoplane.operators import rules


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scopes_and_series(spark):
    sets = spark.createDataFrame([("A", "i1"), ("B", "i2"), ("C", None)], "set_id string, image_id string")
    images = spark.createDataFrame([("i1", "s1"), ("i2", "s2")], "image_id string, series_id string")
    assert values(P.sets_of_series(sets, images, "s1"), "set_id") == [("A",)]
    plans = spark.createDataFrame([(1, "p", True, False), (1, "q", False, True), (2, "r", False, True), (2, "s", None, False), (3, "t", None, None)], "context int, plan string, in_scope boolean, is_active boolean")
    assert values(P.plans_in_scope(plans), "plan") == [("p",), ("r",)]
    one = spark.createDataFrame([(None, "set", "plan"), ("open", None, None)], "a string, b string, c string")
    assert values(one, P.resolve_image(F.col("a"), F.col("b"), F.col("c"))) == [("open",), ("set",)]


def test_nested_prescriptions(spark):
    schema = "course_id int, phases array<struct<phase_id:int, prescriptions:array<struct<rx_id:string, site:string>>>>"
    rows = [(1, [(1, [("a", "x"), ("b", "y")]), (2, [])]), (2, None)]
    assert values(P.prescription_rows(spark.createDataFrame(rows, schema)), "course_id", "phase_id", "rx_id") == [(1, 1, "a"), (1, 1, "b")]


def test_lookups(spark):
    plans = spark.createDataFrame([("p", "PTV_1"), ("q", "ptv_2")], "plan_id string, target_id string")
    assert values(P.plans_of_target(plans, spark.createDataFrame([("PTV_2",)], "target_id string")), "plan_id") == [("q",)]
    coloured = P.with_colours(spark.createDataFrame([("a",), ("b",)], "structure_id string"), spark.createDataFrame([("a", "#fff")], "structure_id string, rgb string"))
    assert [tuple(r) for r in coloured.orderBy("structure_id").collect()] == [("a", "#fff"), ("b", None)]
    models = spark.createDataFrame([(["x", "y"],), (["x"],), (None,)], "m array<string>")
    assert [r[0] for r in models.select(P.models_available(F.col("m"), ["x", "y"])).collect()] == [True, False, False]
    assert models.select(P.display_label(F.lit("S"), F.lit("I"))).first()[0] == "S  (I)"
    assert [r[0] for r in models.select(P.target_names(F.lit("L1-L4"))[0], P.target_names(F.lit("x" * 13))[1]).limit(1).collect()] == ["CTV_L1-L4"]


def test_structures_and_fractions(spark):
    own = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "set_no int, structure_id string, v int")
    copy = spark.createDataFrame([(1, "b", 9), (1, "c", 3)], "set_no int, structure_id string, v int")
    assert values(P.replace_copies(own, copy, ["set_no", "structure_id"]), "structure_id", "v") == [("a", 1), ("b", 9), ("c", 3)]
    found = spark.createDataFrame([(None, True), ("x", True), ("x", False)], "e string, w boolean").select(P.structure_action(F.col("e"), F.col("w")))
    assert [r[0] for r in found.collect()] == ["create", "reuse", "create _ny"]
    plans = spark.createDataFrame([("p", "r1"), ("q", "r2")], "plan_id string, rx_id string")
    targets = spark.createDataFrame([("r1", 2, 5, 1.6), ("r1", 1, 1, 8.0)], "rx_id string, pos int, fractions int, dose_per_fraction double")
    rows = [tuple(r) for r in P.first_fractionation(plans, targets).orderBy("plan_id").collect()]
    assert rows == [("p", "r1", 1, 8.0), ("q", "r2", None, None)]


def test_copy_numbers(spark):
    plans = spark.createDataFrame([(1, "A"), (1, "A kopi 1"), (1, "A kopi 3"), (1, "B"), (2, "A kopi 2")], "course int, plan_id string")
    got = P.free_copy_number(plans, F.regexp_replace("plan_id", " kopi [0-9]+$", ""))
    assert values(got, "course", "base", "number") == [(1, "A", 2), (1, "B", 1), (2, "A", 1)]


def test_copy_numbers_compare_without_case_and_by_spelling(spark):
    plans = spark.createDataFrame([(1, "mv3 KOPI 1"), (1, "MV3 kopi 02"), (1, "MV3_Th9_8"), (1, "MV5_Th9_8")], "course int, plan_id string").withColumn("target_id", F.lit("ptv_th9"))
    wanted = spark.createDataFrame([(1, 7, "Th9", "PTV_Th9"), (1, 8, "L1", "PTV_L1")], "course int, mv int, name string, target_id string")
    assert values(P.plan_ids(wanted, plans), "target_id", "plan_id") == [("PTV_L1", "MV8_L1_8"), ("PTV_Th9", "MV3 kopi 2")]
    rows = spark.createDataFrame([(True, None, None), (True, "s", "a"), (True, "s", "b"), (False, None, None)], "r boolean, s string, i string")
    got = rows.select(P.run_problem(F.col("r"), F.col("s"), F.col("i"), F.lit("a"))).collect()
    assert [r[0] for r in got] == ["no open structure set", None, "open structure set belongs to another image", None]


def test_directions_table(spark):
    rows = [(7.0, "HeadFirstSupine", "RIGHT"), (-9.0, "HeadFirstSupine", "LEFT"), (7.0, "HeadFirstProne", "LEFT"), (7.0, "FeetFirstSupine", "LEFT"), (7.0, "FeetFirstProne", "RIGHT")]
    df = spark.createDataFrame(rows, "lat double, o string, side string")
    assert df.where(rules.implied_side(F.col("lat"), F.col("o")) != F.col("side")).count() == 0
    checks = spark.createDataFrame([("LEFT", 0.0, "HeadFirstSupine", "NONE"), ("LEFT", -1.0, "Sitting", "NONE"), ("LEFT", -1.0, "HeadFirstSupine", "RIGHT"), ("LEFT", -1.0, "HeadFirstSupine", "LEFT")], "t string, lat double, o string, a string")
    got = [r[0] for r in checks.select(rules.lateral_check(F.col("t"), F.col("lat"), F.col("o"), F.col("a"))).collect()]
    assert got == ["WARNING", "INCONCLUSIVE", "WARNING", "OK"]


def test_pair_angles_and_jaws(spark):
    one = spark.range(1).select(rules.pair_angles(F.lit(90.0)).alias("p"), rules.jaw_clamp(F.lit(-100.0), F.lit(100.0)).alias("j"), F.size(rules.meterset_ramp()).alias("n"))
    r = one.first()
    assert tuple(r.p) == (135.0, 225.0) and tuple(r.j) == (-85.0, 85.0) and r.n == 178


def test_timing():
    assert timing.as_text(61) == "1m 01s" and timing.as_text(2.04) == "2.0s"
    with timing.timed("nothing"):
        pass
