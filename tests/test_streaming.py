"""A stream of files gives what the whole table gives."""

from pyspark.sql import functions as F

from boscage.streaming.scans import rolling_occupancy


def test_rolling_occupancy_equals_the_batch(spark, tmp_path):
    rows = spark.range(400).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 30).alias("ts"), (F.col("id") % 7 / 2).alias("X"), (F.col("id") % 3 / 2).alias("Y"), (F.col("id") % 5 / 2).alias("Z"))
    rows.union(rows.limit(3).withColumn("X", F.lit(None).cast("double"))).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = rolling_occupancy(stream, 0.5).writeStream.outputMode("complete").format("memory").queryName("occupancy").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("occupancy").collect())
    assert got == sorted(tuple(r) for r in rolling_occupancy(rows, 0.5).collect()) and sum(r[4] for r in got) == 400
