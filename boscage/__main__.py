"""I4: the command line: python -m boscage segment | qsf | blender | report (or by spark-submit).

Points are LAS files or Parquet with X, Y, Z; results are Parquet, but for models, which come in the formats asked for.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boscage.operators import ground, points as P, qsm, trees, verbs
from boscage.operators._state import cut
from boscage.params import BUFFER, TREE, Params
from boscage.sources import sinks, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="boscage")
    sub = top.add_subparsers(dest="command", required=True)
    for name, buffer in (("segment", 5.0), ("blender", 0.0)):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("-cut", type=float, default=0.25, help="height above ground below which points are no tree's, m")
        c.add_argument("-height", type=float, default=2.0, help="trees below it are understory, m")
        c.add_argument("-buffer", type=float, default=buffer, help="border whose trees are left out, m")
        c.add_argument("-fraction", type=float, default=0.25, help="random share of the points")
        c.add_argument("-center", action="store_true", help="move the scene to the origin")
        c.add_argument("-mesh", action="store_true", help="the terrain's cells as quads as well")
        for what in ("segmented", "trees", "valid-trees", "dtm"):
            c.add_argument(f"-no-{what}", dest=f"no_{what.replace('-', '_')}", action="store_true")
    c = sub.add_parser("qsf")
    c.add_argument("input")
    c.add_argument("-o", "--output")
    c.add_argument("-overwrite", action="store_true")
    c.add_argument("-epsg", type=int, default=0)
    for kind in ("qsm", "csv", "obj", "ply", "stl"):
        c.add_argument(f"-{kind}", action="store_true")
    c = sub.add_parser("report")
    c.add_argument("input", help="models written by qsf")
    return top


def prepared(cloud: DataFrame, center: bool) -> DataFrame:
    """The thinned cloud, moved to the origin if asked for."""
    thin = cut(P.hybrid_homogenise(cut(cloud), Params().path_finder.decimation))
    return cut(P.centre(thin)) if center else thin


def hull_of(cloud: DataFrame) -> list[tuple[float, float]]:
    """The corners of the cloud's hull, as the hull of each batch's hull; only corners reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(P.convex_hull(list(zip(b["X"], b["Y"], strict=True))), columns=["X", "Y"])

    return P.convex_hull([(r["X"], r["Y"]) for r in cloud.select("X", "Y").mapInPandas(run, "X double, Y double").collect()])


def segmented(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(points with trees, flags and colours; terrain) of the input."""
    p = Params(cut_above_ground=a.cut)
    cloud = prepared(tables.read_points(spark, a.input, fraction=a.fraction).select("point_id", "X", "Y", "Z"), a.center or a.command == "blender")
    cloud = cut(ground.segment_ground(cloud))
    terrain = ground.dtm(cloud)
    marked = cut(verbs.segment_semantic(cut(cloud.join(P.anisotropy(cloud, p.woodlikelihood_k), "point_id")), p))
    seeds = cut(verbs.find_seeds(marked, p))
    found = cut(verbs.segment_instance(marked, seeds, p))
    if a.command == "segment":
        found = P.flag_small_trees(found, a.height)
    if a.buffer > 0:
        found = P.flag_buffer(found, hull_of(found), P.tree_roots(found, seeds), -a.buffer)
    return cut(P.colour_trees(found)), terrain


def segment(spark: SparkSession, a: argparse.Namespace) -> str:
    """Writes segmented, trees, dtm (and dtm_quads) below <input>_output; returns that folder."""
    out = f"{os.path.splitext(a.input.rstrip('/'))[0]}_output"
    found, terrain = segmented(spark, a)
    if not a.no_segmented:
        found.write.mode("overwrite").parquet(f"{out}/segmented")
    if not a.no_trees:
        found.where((F.col("UserData") == TREE) & F.col("treeID").isNotNull()).write.mode("overwrite").parquet(f"{out}/trees")
    if not a.no_dtm:
        terrain.write.mode("overwrite").parquet(f"{out}/dtm")
    if a.mesh:
        sinks.raster_quads(terrain).write.mode("overwrite").parquet(f"{out}/dtm_quads")
    return out


def blender(spark: SparkSession, a: argparse.Namespace) -> str:
    """Writes wood and foliage of high and of low trees, models, rings at breast height and the terrain below <input>_blender."""
    out = f"{os.path.splitext(a.input.rstrip('/'))[0]}_blender"
    found, terrain = segmented(spark, a)
    found = found.where(F.col("UserData") != BUFFER)
    models = cut(qsm.qsf(found, a.height).where("cyl_ID is not null"))
    sinks.write(models, f"{out}/its", "obj", "overwrite")
    trees.ring(models).write.mode("overwrite").parquet(f"{out}/rings")
    for size, own in (("high", P.flag_small_trees(found, a.height).where(F.col("UserData") == TREE)), ("low", P.keep_small_trees(found, a.height))):
        own.where("foliage > 0").write.mode("overwrite").parquet(f"{out}/foliage_{size}")
        own.where("foliage = 0").write.mode("overwrite").parquet(f"{out}/wood_{size}")
    sinks.raster_quads(terrain).write.mode("overwrite").parquet(f"{out}/dtm_quads")
    return out


def qsf(spark: SparkSession, a: argparse.Namespace) -> str:
    """Writes the models of a segmented cloud in the formats asked for (qsm if none is) below `output`."""
    out = a.output or os.path.join(os.path.dirname(a.input.rstrip("/")), "qsm")
    models = cut(qsm.qsf(tables.read_points(spark, a.input)).where("cyl_ID is not null"))
    for kind in [k for k in ("qsm", "csv", "obj", "ply", "stl") if getattr(a, k)] or ["qsm"]:
        sinks.write(models, f"{out}/{kind}", kind, "overwrite" if a.overwrite else "error", crs=f"EPSG:{a.epsg}" if a.epsg else "")
    return out


def report(spark: SparkSession, a: argparse.Namespace) -> str:
    """Writes each tree's figures and the forest's below <input>/report."""
    models, _ = tables.read_models(spark, a.input)
    stats = cut(trees.stats_global(models))
    stats.write.mode("overwrite").parquet(f"{a.input}/report/trees")
    trees.forest_report(stats).write.mode("overwrite").parquet(f"{a.input}/report/forest")
    return f"{a.input}/report"


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(arguments)
    return {"segment": segment, "blender": blender, "qsf": qsf, "report": report}[a.command](spark or SparkSession.builder.appName("boscage").getOrCreate(), a)


if __name__ == "__main__":
    main()
