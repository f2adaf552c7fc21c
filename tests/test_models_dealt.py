"""Models of trees: the work is dealt to many tasks, however few bytes the points have."""

from pyspark.sql import functions as F

from boscage.operators import qsm


def test_dealt(spark):
    n = spark.range(160)
    p = n.select((F.col("id") % 16).alias("treeID"), F.lit(0.0).alias("X"), F.lit(0.0).alias("Y"), (F.col("id") / 20).alias("Z"), (F.col("id") / 20).alias("hag"), F.lit(0).alias("foliage"))
    made = qsm.qsm_of(p.unionByName(p.where("treeID = 3").withColumn("treeID", F.lit(None).cast("long"))))
    parts = {x.part for x in made.select(F.spark_partition_id().alias("part")).distinct().collect()}
    assert len(parts) > 1
    rows = made.collect()
    assert {x.tree_id for x in rows} == {None, *range(16)}
    strip = lambda k: sorted(str(tuple(x)[1:]) for x in rows if x.tree_id == k)
    assert strip(None) == strip(3)
