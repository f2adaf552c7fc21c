"""Readers and the views of the driver tables as points, trajectories, circles and cylinders (SURVEY 7.4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boscage.functions.geometry import dbh_of_height


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pts_evt: a point per event."""
    e = read(spark, sf_dir, "events")
    seconds = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 1e6
    i = F.col("event_id")
    return e.select(i.alias("point_id"), (((i * 7919) % 1000) / 100).alias("X"), (((i * 104729) % 997) / 100).alias("Y"), (F.col("value") / 10).alias("Z"), (F.col("value") / 10).alias("hag"), F.col("user_id").alias("treeID"), seconds.alias("gpstime"), (i % 20).cast("int").alias("passage"), (i % 3).cast("int").alias("foliage"), (i % 4).cast("int").alias("UserData"))


def points_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pts_emb: a point per vector from its first three components."""
    e = read(spark, sf_dir, "embeddings")
    x, y, z = ((F.col("embedding")[j].cast("double") * 10).alias(n) for j, n in enumerate("XYZ"))
    return e.select(F.col("vec_id").alias("point_id"), x, y, z, F.col("label").cast("int").alias("treeID"), (F.col("vec_id") % 3).cast("int").alias("foliage"))


def points_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pts_line: a point per order line."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("X"), (F.col("l_extendedprice") / 1000).alias("Y"), (F.col("l_discount") * 100).alias("Z"), (F.col("l_tax") * 100).alias("hag"), F.col("l_suppkey").alias("treeID"))


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj: the events of user 1 in time, as one sensor's path; other users are no part of it."""
    return points_of_events(spark, sf_dir).where("treeID = 1").select("gpstime", F.col("X").alias("x"), F.col("Y").alias("y"), F.col("Z").alias("z"))


def circles_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(s.alias("id"), (F.col("s_acctbal") / 1000).alias("X"), F.col("s_nationkey").cast("double").alias("Y"), (s % 3).cast("double").alias("Z"), (0.02 + (s % 10) / 20).alias("R"))


def cylinders_of_events(spark: SparkSession, sf_dir: str, chain: bool = False) -> DataFrame:
    """cyl_heap (parent = half the number) or cyl_chain (parent = the number before): a tree per user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(w).cast("long").alias("rn"))
    rn = F.col("rn")
    e = e.select(F.col("user_id").alias("tree_id"), rn.alias("cyl_ID"), (rn - 1 if chain else F.expr("rn div 2")).alias("parent_ID"), (rn * 0.02 + F.col("value") * 0.001).alias("endX"), ((rn % 7) * 0.05).alias("endY"), (rn * 0.1 + F.col("value") / 500).alias("endZ"), (0.001 + F.col("value") / 1000).alias("radius"))
    up = e.select("tree_id", F.col("cyl_ID").alias("parent_ID"), *[F.col(f"end{a}").alias(f"start{a}") for a in "XYZ"])
    return e.join(up, ["tree_id", "parent_ID"], "left").fillna(0.0, [f"start{a}" for a in "XYZ"]).select("tree_id", "cyl_ID", "parent_ID", *[f"start{a}" for a in "XYZ"], *[f"end{a}" for a in "XYZ"], "radius")


def read_trajectory(spark: SparkSession, path: str, dt: float = 0.5) -> DataFrame:
    """A CSV whose first columns are time, x, y, z; thinned to the first row of each dt, in time order."""
    t = spark.read.csv(path, header=True, inferSchema=True)
    if len(t.columns) < 4:
        raise ValueError("a trajectory has four columns at least")
    return thin(t.withColumnRenamed(t.columns[0], "gpstime"), dt)


def thin(t: DataFrame, dt: float) -> DataFrame:
    if dt <= 0:
        return t
    rn = F.row_number().over(Window.partitionBy(F.floor(F.col("gpstime") / dt)).orderBy("gpstime"))
    return t.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def read_cylinders_csv(spark: SparkSession, path: str) -> DataFrame:
    """A cylinder table in CSV; older column names are renamed."""
    return spark.read.csv(path, header=True, inferSchema=True).withColumnsRenamed({"branchOrder": "branch_order", "parent_segment_ID": "parent_ID", "segment_ID": "cyl_ID"})


def skeleton_edges(content: bytes) -> pd.DataFrame:
    """The edges of a binary little-endian PLY of vertices (x, y, z, radius, single precision) and of lines of vertices.

    A line is cut into its pairs; pairs with a vertex that isn't there, and lines of fewer than two, are left out.
    """
    end = content.index(b"end_header")
    at = content.index(b"\n", end) + 1
    count = {w[1]: int(w[2]) for w in (x.split() for x in content[:end].decode("ascii", "replace").splitlines()) if len(w) == 3 and w[0] == "element"}
    n = count.get("vertex", 0)
    v = np.frombuffer(content, "<f4", 4 * n, at).reshape(n, 4).astype(float)
    ints = np.frombuffer(content, "<i4", (len(content) - at) // 4 - 4 * n, at + 16 * n)
    pairs, i = [np.zeros((0, 2), int)], 0
    for _ in range(count.get("edge", 0)):
        size = int(ints[i]) if i < len(ints) else -1
        line = ints[i + 1 : i + 1 + size]
        if size < 0 or len(line) < size:
            raise ValueError("the file ends within its edges")
        pairs.append(np.column_stack([line[:-1], line[1:]]).astype(int))
        i += 1 + size
    e = np.concatenate(pairs)
    a, b = e[((e >= 0) & (e < n)).all(1)].T
    out = {f"{k}{c}": v[x, j] for k, x in (("start", a), ("end", b)) for j, c in enumerate("XYZ")}
    return pd.DataFrame({**out, "radius1": v[a, 3], "radius2": v[b, 3], "cyl_ID": b, "parent_ID": a})


def read_skeleton_ply(spark: SparkSession, path: str) -> DataFrame:
    """(file, startX..endZ, radius1, radius2, cyl_ID, parent_ID) of skeleton files; a task reads a file whole."""
    schema = "file string, " + ", ".join(f"{e}{a} double" for e in ("start", "end") for a in "XYZ") + ", radius1 double, radius2 double, cyl_ID long, parent_ID long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                t = skeleton_edges(content)
                t.insert(0, "file", file)
                yield t

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cylinders, trees) as sinks.write(kind="qsm") left them."""
    return spark.read.parquet(f"{path}/cylinders"), spark.read.parquet(f"{path}/trees")


def read_points(spark: SparkSession, path: str, select: str | None = None, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """Points of LAS files or of Parquet; columns and the random share are left to the scan.  Both get a point_id."""
    if path.lower().endswith((".las", ".laz")):
        from boscage.sources.las import register

        register(spark)
        r = spark.read.format("las").option("fraction", fraction).option("seed", seed)
        t = (r.option("select", select) if select else r).load(path)
    else:
        t = spark.read.parquet(path)
        t = t.select(*select.split(",")) if select else t
        t = t.sample(fraction, seed) if fraction < 1 else t
    return t if "point_id" in t.columns else t.withColumn("point_id", F.monotonically_increasing_id())


def allometry_table(spark: SparkSession, model: str = "Griese2025") -> DataFrame:
    """(H, DBH) for heights 0 to 40 by half metres."""
    return spark.range(81).select((F.col("id") * 0.5).alias("H")).withColumn("DBH", dbh_of_height(F.col("H"), model))
