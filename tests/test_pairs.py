"""Distances of many pairs of points and cylinders: right, and small enough to be compiled."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from boscage.functions import geometry as G

#: Fixed value: methods of more bytes are interpreted (Spark falls back, the JVM never compiles them).
LARGEST = 8000


def largest_method(spark, df) -> int:
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    found = getattr(debug, "MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))


def test_compiled(spark):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("point_cyl_distance", "segment_by_model", "segment_distance"):
            assert 0 < largest_method(spark, entry.queries()[name](spark, "/root/testdata/sf0.001")) < LARGEST, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_as_one_expression(spark):
    r = np.random.default_rng(3)
    rows = [tuple(map(float, x)) for x in r.normal(size=(300, 10))]
    rows += [(0.0, 0.0, 5.0, 0, 0, 0, 0, 0, 1, 0.5), (0.2, 0.0, 1.0, 0, 0, 0, 0, 0, 1, 0.5), (0.1, 0, 0, 1, 1, 1, 1, 1, 1, 0.5), (3.0, 0, 0.5, 0, 0, 0, 0, 0, 1, None), (None, 0, 0, 0, 0, 0, 0, 0, 1, 0.5)]
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in t) for t in rows], ", ".join(f"{c} double" for c in ("X", "Y", "Z", *(f"{e}{a}" for e in ("start", "end") for a in "XYZ"), "radius")))
    for plain, staged in ((G.surface_distance, G.with_surface_distance), (G.segment_distance, G.with_segment_distance)):
        for a, b in staged(df.withColumn("plain", plain(*map(F.col, "XYZ"))), *"XYZ").select("plain", "dist").collect():
            assert (a is None and b is None) or abs(a - b) < 1e-12
