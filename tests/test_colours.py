from isoplane.operators import planning as P


def test_colours_of_a_large_table(spark):
    ids = spark.range(3000).selectExpr("cast(id as string) as structure_id")
    coloured = P.with_colours(ids, ids.selectExpr("structure_id", "concat('#', structure_id) as rgb"))
    assert coloured.where("rgb = concat('#', structure_id)").count() == 3000
