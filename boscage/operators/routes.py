"""Path graphs over point clouds in layers: core, targets, seeds and one master, with repairs.

Nodes are numbers: four times the point_id for core points, one more for targets, two more for seeds; the master is -1.
Edges are (src, dst, cost).  Everything is a shuffled join; the only broadcasts are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscage.operators import spatial
from boscage.operators._state import cut
from boscage.operators.graph import ancestors, components, passages, reachable, shortest_paths
from boscage.operators.points import homogenise, hybrid_homogenise
from boscage.operators.spatial import knn_join, nearest
from boscage.params import Instance, PathFinder

MASTER = -1


def core(c: Column) -> Column:
    return c * 4


def target(c: Column) -> Column:
    return c * 4 + 1


def seed(c: Column) -> Column:
    return c * 4 + 2


def step_cost(d: Column, rise: Column, p: PathFinder, was: Column | None = None, now: Column | None = None, wood: Instance | None = None) -> Column:
    """d^power, times the penalty of the angle to upwards (to downwards if so set), times the factor of wood and leaf."""
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(d > 0, rise / d).otherwise(1.0)))))
    table = F.array(*[F.lit(float(x)) for x in p.penalty])
    cost = F.pow(d, F.lit(float(p.distance_power))) * F.get(table, F.rint(180 - angle if p.downward else angle).cast("int"))
    if wood is None:
        return cost
    return cost * F.when(was & now, wood.wood2wood).when(~was & ~now, wood.leaf2leaf).when(was, wood.wood2leaf).otherwise(1.0)


def _steps(sources: DataFrame, points: DataFrame, k: int, p: PathFinder, wood: Instance | None) -> DataFrame:
    """(a, b, there, back): costs of the steps between each source and its k nearest others within max_gap, both ways."""
    more = ("Z", "foliage") if wood else ("Z",)
    own = sources.select(F.col("point_id").alias("qid"), F.col("Z").alias("z0"), *([(F.col("foliage") == 0).alias("w0")] if wood else []))
    n = knn_join(sources, points, k + 1, more).where("qid <> point_id").where(F.sqrt("d2") <= p.max_gap).join(own, "qid")
    d, w0, w1 = F.sqrt("d2"), F.col("w0") if wood else None, (F.col("foliage") == 0) if wood else None
    return n.select(F.col("qid").alias("a"), F.col("point_id").alias("b"), step_cost(d, F.col("Z") - F.col("z0"), p, w0, w1, wood).alias("there"), step_cost(d, F.col("z0") - F.col("Z"), p, w1, w0, wood).alias("back"))


def core_edges(points: DataFrame, p: PathFinder, wood: Instance | None = None) -> DataFrame:
    """G1, J7."""
    return _steps(points, points, p.k_neighborhood_connectivity, p, wood).select(core(F.col("a")).alias("src"), core(F.col("b")).alias("dst"), F.col("there").alias("cost"))


def target_edges(points: DataFrame, targets: DataFrame) -> DataFrame:
    """From the core point nearest to each target, for nothing."""
    return nearest(targets, points).select(core(F.col("point_id")).alias("src"), target(F.col("qid")).alias("dst"), F.lit(0.0).alias("cost"))


def seed_edges(seeds: DataFrame, points: DataFrame, p: PathFinder) -> DataFrame:
    """From each seed to its nearest core points, whatever the gap or angle."""
    n = knn_join(seeds, points, p.k_seed_connectivity)
    return n.select(seed(F.col("qid")).alias("src"), core(F.col("point_id")).alias("dst"), F.pow(F.sqrt("d2"), F.lit(float(p.distance_power))).alias("cost"))


def master_edges(seeds: DataFrame) -> DataFrame:
    """From the master to every seed, for nothing."""
    return seeds.select(F.lit(MASTER).cast("long").alias("src"), seed(F.col("point_id")).alias("dst"), F.lit(0.0).alias("cost"))


def places(points: DataFrame) -> DataFrame:
    """(node, block) of the points' nodes of every layer, for graph.shortest_paths()."""
    at = cut(spatial.places(points))
    return at.select(F.explode(F.array(*[f(F.col("node")) for f in (core, target, seed)])).alias("node"), "block")


def from_master(spark) -> DataFrame:
    return spark.range(1).select(F.lit(MASTER).cast("long").alias("node"))


def layered(points: DataFrame, seeds: DataFrame, p: PathFinder, targets: DataFrame | None = None, wood: Instance | None = None) -> DataFrame:
    """G2, V3f: core, target, seed and master edges; without points or seeds, or without foliage where it counts, an error."""
    if points.isEmpty() or seeds.isEmpty():
        raise ValueError("a graph needs points and seeds")
    if wood and "foliage" not in points.columns:
        raise ValueError("the point cloud has no foliage")
    edges = core_edges(points, p, wood)
    if targets is not None:
        edges = edges.unionByName(target_edges(points, targets))
    return cut(edges.unionByName(seed_edges(seeds, points, p)).unionByName(master_edges(seeds)))


def unreached(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Core points that the master doesn't reach."""
    seen = reachable(edges, from_master(points.sparkSession), places(points))
    return points.join(seen.select(F.expr("node div 4").alias("point_id"), (F.col("node") % 4).alias("kind")).where("kind = 0 and point_id >= 0").select("point_id"), "point_id", "left_anti")


def repair_nodes(edges: DataFrame, points: DataFrame, p: PathFinder, wood: Instance | None = None) -> DataFrame:
    """What core points out of reach lead to is dropped; they get four times as many neighbours, both ways, within
    max_gap and at full cost.  (edges as they are where all is in reach.)"""
    lost = cut(unreached(edges, points))
    if lost.isEmpty():
        return edges
    kept = edges.join(lost.select(core(F.col("point_id")).alias("src")), "src", "left_anti").select("src", "dst", "cost")
    n = cut(_steps(lost, points, 4 * p.k_neighborhood_connectivity, p, wood))
    there = n.select(core(F.col("a")).alias("src"), core(F.col("b")).alias("dst"), F.col("there").alias("cost"))
    back = n.select(core(F.col("b")).alias("src"), core(F.col("a")).alias("dst"), F.col("back").alias("cost"))
    return cut(kept.unionByName(there).unionByName(back).groupBy("src", "dst").agg(F.min("cost").alias("cost")))


def isolated_clusters(edges: DataFrame, lost: DataFrame) -> DataFrame:
    """(point_id, cluster): components, over edges among them, of core points out of reach."""
    own = lost.select(core(F.col("point_id")).alias("node"))
    among = edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return components(own, among.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.expr("node div 4").alias("point_id"), F.expr("component div 4").alias("cluster"))


def repair_clusters(edges: DataFrame, points: DataFrame, p: PathFinder) -> DataFrame:
    """Each cluster out of reach is bridged, both ways, where it comes nearest to what is in reach."""
    lost = cut(unreached(edges, points))
    if lost.isEmpty():
        return edges
    held = points.join(lost.select("point_id"), "point_id", "left_anti")
    near = nearest(lost, held).join(isolated_clusters(edges, lost).select(F.col("point_id").alias("qid"), "cluster"), "qid")
    bridge = near.groupBy("cluster").agg(F.min(F.struct("d2", "qid", "point_id")).alias("b")).select("b.*")
    cost = F.pow(F.sqrt("d2"), F.lit(float(p.distance_power))).alias("cost")
    ends = core(F.col("qid")), core(F.col("point_id"))
    both = bridge.select(ends[0].alias("src"), ends[1].alias("dst"), cost).unionByName(bridge.select(ends[1].alias("src"), ends[0].alias("dst"), cost))
    return cut(edges.unionByName(both))


def accumulate_passages(points: DataFrame, ground: DataFrame, p: PathFinder) -> DataFrame:
    """Points with `passage`: how many targets (the core thinned to space_res) have their cheapest path from the ground
    through each core point (the cloud thinned to `decimation`); 0 for points that were thinned out."""
    thin = cut(hybrid_homogenise(points, p.decimation))
    targets = homogenise(thin, p.space_res)
    edges = repair_nodes(layered(thin, ground, p, targets), thin, p)
    best = shortest_paths(edges, from_master(points.sparkSession), places(thin))
    through = passages(best, targets.select(target(F.col("point_id")).alias("node"))).where("node >= 0 and node % 4 = 0")
    count = through.select(F.expr("node div 4").alias("point_id"), F.col("passage").cast("int").alias("passage"))
    return points.drop("passage").join(count, "point_id", "left").withColumn("passage", F.coalesce("passage", F.lit(0)))


def dist2root(points: DataFrame, ground: DataFrame, k: int = 80, max_gap: float = 1.5, power: float = 2.0) -> DataFrame:
    """Points with `dist2root`: length of the cheapest path from the ground through core points; -1 out of reach.

    The way from a seed to its first core point counts nothing.
    """
    p = PathFinder(k_neighborhood_connectivity=k, k_seed_connectivity=k, max_gap=max_gap, distance_power=power, penalty=(1.0,) * 181)
    edges = repair_clusters(layered(points, ground, p), points, p)
    best = shortest_paths(edges, from_master(points.sparkSession), places(points)).where("node >= 0 and node % 4 = 0")
    at = points.select("point_id", *[F.col(a).alias(f"_{a}") for a in "XYZ"])
    own = best.select(F.expr("node div 4").alias("node"), F.when(F.col("pred") % 4 == 0, F.expr("pred div 4")).alias("parent"))
    own = own.join(at.withColumnRenamed("point_id", "node"), "node").join(at.select(F.col("point_id").alias("parent"), *[F.col(f"_{a}").alias(f"p{a}") for a in "XYZ"]), "parent", "left")
    way = F.coalesce(F.sqrt(sum(((F.col(f"_{a}") - F.col(f"p{a}")) ** 2 for a in "XYZ"), F.lit(0.0))), F.lit(0.0))
    found = ancestors(own.select("node", "parent", way.alias("way")), [], {"dist2root": F.col("way")}, False)
    return points.join(found.withColumnRenamed("node", "point_id"), "point_id", "left").withColumn("dist2root", F.coalesce("dist2root", F.lit(-1.0)))
