"""Rolling voxel occupancy of a stream of points (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.functions.geometry import voxel


def rolling_occupancy(points: DataFrame, res: float, time: str = "ts", span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A3 over time: (start, vx, vy, vz, n, top) of each span and voxel, voxels counted from the origin.

    Points later than `late` behind the newest are dropped, as state for them is gone; null times or places are not counted.
    """
    cells = [voxel(F.col(a), 0.0, res).alias(v) for v, a in zip(("vx", "vy", "vz"), "XYZ", strict=True)]
    known = points.dropna(subset=[time, "X", "Y", "Z"]).withWatermark(time, late)
    counted = known.groupBy(F.window(time, span).alias("w"), *cells).agg(F.count("*").alias("n"), F.max("Z").alias("top"))
    return counted.select(F.col("w.start").alias("start"), "vx", "vy", "vz", "n", "top")
