"""OBJ lines: what is shuffled grows with cylinders, not with their lines."""

from boscage.plans.queries import heap
from boscage.sources import sinks


def test_lines_are_not_shuffled(spark):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = sinks.obj_lines(heap(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    above = plan[: plan.rindex("Generate explode")]
    assert plan.count("Generate explode") == 1 and not any(x in above for x in ("Exchange", "Sort", "Window", "Union"))


def test_lines_of_one_cylinder(spark):
    names = ["startX", "startY", "startZ", "endX", "endY", "endZ", "radius"]
    df = spark.createDataFrame([(1, 5, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0, 1.0), (1, 9, 0.0, 0.0, 2.0, 0.0, 0.0, 2.0, 1.0), (1, 7, 0.0, 0.0, 2.0, 0.0, 0.0, 3.0, 0.5)], ", ".join(["tree_id long", "cyl_ID long", *(f"{n} double" for n in names)]))
    got = {(r.cyl_ID, r.kind, r.n): r.line for r in sinks.obj_lines(df, 4).collect()}
    assert len(got) == 2 * (8 + 8) and {c for c, _, _ in got} == {5, 7}
    assert got[5, "v", 1] == "v 1.000 0.000 0.000" and got[7, "v", 13] == "v 0.500 0.000 3.000" and got[7, "v", 10] == "v 0.000 0.500 2.000"
    assert got[5, "f", 0] == "f 1 2 6" and got[5, "f", 1] == "f 1 6 5" and got[7, "f", 8] == "f 9 10 14"
