"""Point-cloud operators: voxels, outliers, local shape, flags, seeds' filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boscage.functions.geometry import voxel
from boscage.operators._state import cut
from boscage.operators.graph import components
from boscage.operators.spatial import knn_join, radius_join
from boscage.params import BUFFER, LOW, TREE, UNDERSTORY

VOXEL = ["vx", "vy", "vz"]


def bbox(points: DataFrame) -> DataFrame:
    """One row of least and greatest coordinates."""
    return points.agg(*[f(a).alias(n + a) for n, f in (("min", F.min), ("max", F.max)) for a in "XYZ"])


def with_voxels(points: DataFrame, res: float) -> DataFrame:
    """Voxel of each point, counted from the cloud's least corner; the corner is one broadcast row."""
    corner = points.agg(*[F.min(a).alias(f"least{a}") for a in "XYZ"])
    return points.crossJoin(F.broadcast(corner)).withColumns({v: voxel(F.col(a), F.col(f"least{a}"), res) for v, a in zip(VOXEL, "XYZ", strict=True)}).drop("leastX", "leastY", "leastZ")


def voxel_occupancy(points: DataFrame, res: float) -> DataFrame:
    """A3: occupied voxels with their number of points."""
    return with_voxels(points, res).groupBy(*VOXEL).agg(F.count("*").alias("n"))


def homogenise(points: DataFrame, res: float) -> DataFrame:
    """A1: of each voxel the point nearest to the voxel's mean, ties to the smaller point_id; one shuffle by voxel."""
    w = Window.partitionBy(*VOXEL)
    v = with_voxels(points, res).withColumns({f"m{a}": F.avg(a).over(w) for a in "XYZ"})
    d2 = F.round((F.col("X") - F.col("mX")) ** 2 + (F.col("Y") - F.col("mY")) ** 2 + (F.col("Z") - F.col("mZ")) ** 2, 9)
    near = v.groupBy(*VOXEL).agg(F.min_by(F.struct(*points.columns), F.struct(d2.alias("d2"), "point_id")).alias("best"))
    return near.select("best.*")


def hybrid_homogenise(points: DataFrame, res: float, share: float = 0.1, seed: int = 42) -> DataFrame:
    """A2: homogenise() and again so many of the removed points as `share` of the kept ones, in the order of a digest.

    The digests' first four figures are counted; groups below the one that holds the last place are taken whole, and only
    within that one, a 65,536th of the points, digests are sorted.
    """
    kept = cut(homogenise(points, res))
    n = int(math.floor(share * kept.count()))
    digest = F.md5(F.concat(F.col("point_id").cast("string"), F.lit(f"-{seed}")))
    rest = points.join(kept.select("point_id"), "point_id", "left_anti").withColumns({"_digest": digest, "_group": F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")})
    before, edge = 0, -1
    for r in sorted(rest.groupBy("_group").count().collect()):
        edge = r["_group"]
        if before + r["count"] >= n:
            break
        before += r["count"]
    last = rest.where(F.col("_group") == edge).orderBy("_digest", "point_id").limit(max(0, n - before))
    again = rest.where(F.col("_group") < edge).unionByName(last) if n else rest.where("false")
    return kept.unionByName(again.select(*points.columns))


def centre(points: DataFrame) -> DataFrame:
    """P5: x and y less their rounded means, z less its rounded least."""
    at = points.agg(F.round(F.avg("X"), 1).alias("ox"), F.round(F.avg("Y"), 1).alias("oy"), F.round(F.min("Z"), 1).alias("oz"))
    return points.crossJoin(F.broadcast(at)).withColumns({"X": F.col("X") - F.col("ox"), "Y": F.col("Y") - F.col("oy"), "Z": F.col("Z") - F.col("oz")}).drop("ox", "oy", "oz")


def translate(points: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    """Coordinates less an offset."""
    return points.withColumns({"X": F.col("X") - dx, "Y": F.col("Y") - dy, "Z": F.col("Z") - dz})


def scale(points: DataFrame, sx: float, sy: float, sz: float) -> DataFrame:
    """P2."""
    return points.withColumns({"X": F.col("X") * sx, "Y": F.col("Y") * sy, "Z": F.col("Z") * sz})


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both with the columns that both have."""
    both = [c for c in a.columns if c in b.columns]
    return a.select(*both).unionByName(b.select(*both))


def filter_range(points: DataFrame, distance: float = 15, hag_max: float = 4) -> DataFrame:
    """F6."""
    return points.where((F.col("hag") >= hag_max) | (F.col("range") <= distance))


def cut_low(points: DataFrame, cut: float = 0.25) -> DataFrame:
    """points at or below the cut are marked LOW."""
    return points.withColumn("UserData", F.when(F.col("hag") > cut, F.col("UserData")).otherwise(LOW))


def wood_slices(points: DataFrame, slices: tuple[float, ...] = (0.7, 0.9), thickness: float = 0.05) -> DataFrame:
    """wood within half a thickness of a slice; the lowest slice is one thickness above the least height."""
    least = points.agg((F.min("hag") + thickness).alias("low"))
    p = points.where("foliage = 0").crossJoin(F.broadcast(least))
    near = F.abs(F.col("hag") - F.col("low")) < thickness / 2
    for s in slices:
        near = near | (F.abs(F.col("hag") - s) < thickness / 2)
    return p.where(near).drop("low")


def long_passages(points: DataFrame, min_passage: int = 15, slices: tuple[float, ...] = (0.7, 0.9)) -> DataFrame:
    """F11."""
    return points.where((F.col("passage") > min_passage) & (F.col("hag") < max(slices) + 0.2))


def short_passages(points: DataFrame) -> DataFrame:
    """F12."""
    least = points.agg(F.min("hag").alias("low"))
    return points.crossJoin(F.broadcast(least)).where("passage > 1 and passage < 10 and hag < low + 0.5").drop("low")


def densify(points: DataFrame, step: float = 0.01) -> DataFrame:
    """U4: each point and two copies beside it in x and in height, copies with passage -1."""
    moves = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(d).alias("d")) for s, d in ((0, 0.0), (-1, -step), (1, step))])
    return points.withColumn("m", F.explode(moves)).withColumns({"X": F.col("X") + F.col("m.d"), "Z": F.col("Z") - F.col("m.d"), "passage": F.when(F.col("m.s") == 0, F.col("passage")).otherwise(-1)}).drop("m")


def outside_safe_zone(points: DataFrame, circles: DataFrame, zone: float = 0.2) -> DataFrame:
    """points that no circle (id, X, Y, Z, R) has in its ring between r + 0.02 and r + zone.

    Equi-join on cells as wide as the largest ring, so neither side has to be small.
    """
    r = circles.agg(F.max("R")).first()[0]
    if r is None:
        return points
    rings = circles.select(F.col("id").alias("point_id"), "X", "Y", "Z", "R")
    hit = radius_join(points, rings, float(r) + zone, ("R",)).where((F.sqrt("d2") > F.col("R") + 0.02) & (F.sqrt("d2") < F.col("R") + zone))
    return points.join(hit.select(F.col("qid").alias("point_id")).distinct(), "point_id", "left_anti")


def sor(points: DataFrame, k: int, m: float) -> DataFrame:
    """A4: (point_id, mean_d, noise): mean distance to the k nearest others, noise beyond mean + m standard deviations."""
    if k <= 2:
        raise ValueError("k has to be above 2")
    near = knn_join(points, points, k + 1).where("qid <> point_id and d2 > 0")
    mean = cut(near.groupBy(F.col("qid").alias("point_id")).agg(F.avg(F.sqrt("d2")).alias("mean_d")))
    every = mean.agg(F.avg("mean_d").alias("a"), F.stddev_samp("mean_d").alias("s"))
    return mean.crossJoin(F.broadcast(every)).select("point_id", "mean_d", (F.col("mean_d") > F.col("a") + m * F.col("s")).alias("noise"))


def anisotropy(points: DataFrame, k: int) -> DataFrame:
    """A5: (point_id, pwood): (largest - least eigenvalue) / largest of the k neighbours' covariance, in closed form."""
    near = knn_join(points, points, k, ("X", "Y", "Z"))
    pairs = (("xx", "X", "X"), ("yy", "Y", "Y"), ("zz", "Z", "Z"), ("xy", "X", "Y"), ("xz", "X", "Z"), ("yz", "Y", "Z"))
    c = near.groupBy(F.col("qid").alias("point_id")).agg(*[F.covar_samp(a, b).alias(n) for n, a, b in pairs])
    return c.select("point_id", _anisotropy().alias("pwood"))


def _anisotropy() -> Column:
    xx, yy, zz, xy, xz, yz = (F.col(n) for n in ("xx", "yy", "zz", "xy", "xz", "yz"))
    trace = xx + yy + zz
    q = trace / 3
    p = F.sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))) / 3
    high, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return F.when((trace < 1e-14) | (p <= 0) | trace.isNull(), 0.0).otherwise((high - low) / high)


def smooth(points: DataFrame, r: float) -> DataFrame:
    """(point_id, X, Y, Z): mean of the points nearer than r."""
    near = radius_join(points, points, r, ("X", "Y", "Z"))
    return near.groupBy(F.col("qid").alias("point_id")).agg(*[F.avg(a).alias(a) for a in "XYZ"])


def dilate(points: DataFrame, wood: Column, k: int, distance: float, strict: bool = False) -> DataFrame:
    """J12 (strict: nearer than the distance), J13 (within it): ids of wood and of such k nearest neighbours of wood."""
    own = points.where(wood)
    near = knn_join(own, points, k).where(F.col("d2") < distance * distance if strict else F.col("d2") <= distance * distance)
    return near.select("point_id").union(own.select("point_id")).distinct()


def _offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Forward neighbours of a voxel that share a face, an edge or a corner with it."""
    most = {6: 1, 18: 2, 26: 3}
    if connectivity not in most:
        raise ValueError("connectivity is 6, 18 or 26")
    every = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    return [o for o in every if o > (0, 0, 0) and sum(map(abs, o)) <= most[connectivity]]


def voxel_components(points: DataFrame, res: float, connectivity: int = 26, by: tuple[str, ...] = (), stretch: float = 1.0) -> DataFrame:
    """(point_id, cluster): components of touching voxels, numbered from 1 in order of their first voxel (within `by`).

    Voxels are counted from the least coordinate rounded down to the grid.
    """
    around = _offsets(connectivity)
    base = points.agg(*[(F.floor(F.min(F.col(a) * (stretch if a == "Z" else 1)) / res) * res).alias(f"least{a}") for a in "XYZ"])
    v = points.crossJoin(F.broadcast(base)).select("point_id", *by, *[voxel(F.col(a) * (stretch if a == "Z" else 1), F.col(f"least{a}"), res).alias(n) for n, a in zip(VOXEL, "XYZ", strict=True)])
    key = [*by, *VOXEL]
    cells = v.select(*key).distinct()
    if by:
        cells = cells.withColumn("node", F.xxhash64(*key))
    else:  # three counts of 21 bits each: the order of numbers is that of voxels
        most = cells.agg(F.max(F.greatest(*VOXEL))).first()[0] or 0
        if most >= 1 << 21:
            raise ValueError("more than two million voxels along an axis: take a larger res")
        cells = cells.withColumn("node", F.shiftleft("vx", 42) + F.shiftleft("vy", 21) + F.col("vz"))
    cells = cut(cells)
    moved = cells.withColumn("o", F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip("abc", o, strict=True)]) for o in around])))
    moved = moved.select(F.col("node").alias("a"), *by, *[(F.col(n) + F.col("o")[x]).alias(n) for n, x in zip(VOXEL, "abc", strict=True)])
    edges = moved.join(cells, key).select("a", F.col("node").alias("b"))
    found = cut(components(cells, edges).join(cells, "node"))
    first = found.groupBy(*by, "component").agg(F.min(F.struct(*VOXEL)).alias("first"))
    if by:
        number = first.withColumn("cluster", F.row_number().over(Window.partitionBy(*by).orderBy("first"))).drop("first")
    else:
        number = dense_numbers(first, "first").withColumnRenamed("number", "cluster").drop("first")
    return v.join(found.join(number, [*by, "component"]), key).select("point_id", *by, "cluster")


def dense_numbers(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `number` from 1 in the order of columns that tell them apart: counted in ranges, no range holds all rows.

    One count a range reaches the driver.
    """
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_id", 33)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    start, at = {}, 0
    for p in sorted(sizes):
        start[p], at = at, at + sizes[p]
    if not start:
        return ranged.withColumn("number", F.lit(0)).drop("_id")
    base = ranged.sparkSession.createDataFrame(list(start.items()), "_part int, _base long")  # a row a range
    counted = ranged.withColumn("_part", part.cast("int")).join(F.broadcast(base), "_part")
    return counted.withColumn("number", (F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("_id", "_part", "_base")


def large_components(points: DataFrame, res: float, least: int, connectivity: int = 26) -> DataFrame:
    """voxel_components() with clusters of fewer points than `least` numbered 0."""
    c = voxel_components(points, res, connectivity)
    n = c.groupBy("cluster").agg(F.count("*").alias("n"))
    return c.join(n, "cluster").select("point_id", F.when(F.col("n") >= least, F.col("cluster")).otherwise(0).alias("cluster"))


def largest_component(points: DataFrame, res: float, by: str = "treeID", stretch: float = 1.0) -> DataFrame:
    """(point_id, largest): whether a point is in its group's largest component, ties to the first."""
    c = voxel_components(points, res, 26, (by,), stretch)
    n = c.groupBy(by, "cluster").agg(F.count("*").alias("n")).groupBy(by).agg(F.max(F.struct("n", (-F.col("cluster")).alias("c"))).alias("m")).select(by, (-F.col("m.c")).alias("best"))
    return c.join(n, by).select("point_id", by, (F.col("cluster") == F.col("best")).alias("largest"))


def layer_clusters(points: DataFrame, layer: str, eps: float) -> DataFrame:
    """(point_id, cluster): within each layer, components of points nearer than eps, numbered across layers."""
    flat = points.select("point_id", "X", "Y", "Z", layer)
    near = radius_join(flat, flat, eps, (layer,)).join(flat.select(F.col("point_id").alias("qid"), F.col(layer).alias("own")), "qid").where((F.col(layer) == F.col("own")) & (F.col("qid") > F.col("point_id")))
    c = components(flat.select(F.col("point_id").alias("node")), near.select(F.col("qid").alias("a"), F.col("point_id").alias("b")))
    found = cut(flat.join(c, flat["point_id"] == c["node"]).select("point_id", layer, "component"))
    number = dense_numbers(found.select(layer, "component").distinct(), layer, "component").withColumnRenamed("number", "cluster")
    return found.join(number, [layer, "component"]).select("point_id", layer, "cluster")


def flag_small_trees(points: DataFrame, max_height: float = 2) -> DataFrame:
    """Rows of trees that do not stand on both sides of the height become UNDERSTORY, LOW ones stay."""
    tall = points.where("treeID > 0").groupBy("treeID").agg(F.max("hag").alias("top"), F.min("hag").alias("foot")).where((F.col("top") > max_height) & (F.col("foot") < max_height)).select("treeID", F.lit(True).alias("tall"))
    first = F.when(F.col("UserData") == UNDERSTORY, TREE).otherwise(F.col("UserData"))
    return points.withColumn("UserData", first).join(tall, "treeID", "left").withColumn("UserData", F.when((F.col("UserData") != LOW) & F.col("tall").isNull(), UNDERSTORY).otherwise(F.col("UserData"))).drop("tall").select(*points.columns)


def keep_small_trees(points: DataFrame, max_height: float) -> DataFrame:
    """F15."""
    low = points.groupBy("treeID").agg(F.max("hag").alias("top")).where(F.col("top") < max_height)
    return points.join(low, "treeID", "left_semi")


def eligible_trees(points: DataFrame, min_height: float = 2) -> DataFrame:
    """F16: TREE rows of trees that reach the height."""
    if min_height < 2:
        raise ValueError("min_height has to be 2 at least")
    own = points.where((F.col("treeID") > 0) & (F.col("treeID") < 2**31 - 1) & (F.col("UserData") == TREE))
    return own.join(own.groupBy("treeID").agg(F.max("hag").alias("top")).where(F.col("top") >= min_height), "treeID", "left_semi")


def tree_roots(points: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Mean of a tree's seeds, or of its lowest 100 points if it has ten or more."""
    if seeds is not None:
        return seeds.where("treeID > 0").groupBy("treeID").agg(*[F.avg(a).alias(a) for a in "XYZ"])
    low = points.where("treeID > 0").withColumn("rn", F.row_number().over(Window.partitionBy("treeID").orderBy("Z", "point_id"))).where("rn <= 100")
    return low.groupBy("treeID").agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in "XYZ"]).where("n >= 10").drop("n")


def convex_hull(xy: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull, counter-clockwise (monotone chain)."""
    pts = sorted(set(xy))
    if len(pts) < 3:
        return pts
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out = []
    for run in (pts, pts[::-1]):
        side: list = []
        for p in run:
            while len(side) > 1 and cross(side[-2], side[-1], p) <= 0:
                side.pop()
            side.append(p)
        out += side[:-1]
    return out


def inside_hull(x: Column, y: Column, hull: list[tuple[float, float]], buffer: float) -> Column:
    """Whether a point lies in the hull moved inwards by -buffer: beyond no edge's shifted line."""
    ok = F.lit(len(hull) >= 3)
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
        n = math.hypot(bx - ax, by - ay)
        ok = ok & (((x - ax) * (ay - by) + (y - ay) * (bx - ax)) / n >= -buffer)
    return ok


def flag_buffer(points: DataFrame, hull: list[tuple[float, float]], roots: DataFrame, buffer: float = -5) -> DataFrame:
    """Rows of trees whose root lies outside the shrunken hull become BUFFER, LOW ones stay."""
    if buffer > 0:
        raise ValueError("the buffer has to be negative")
    inner = roots.where(inside_hull(F.col("X"), F.col("Y"), hull, buffer)).select("treeID", F.lit(True).alias("inner"))
    first = F.when(F.col("UserData") == BUFFER, TREE).otherwise(F.col("UserData"))
    return points.withColumn("UserData", first).join(inner, "treeID", "left").withColumn("UserData", F.when((F.col("UserData") != LOW) & F.col("inner").isNull(), BUFFER).otherwise(F.col("UserData"))).drop("inner").select(*points.columns)


def reassign_trees(points: DataFrame, change: list[int], keep: int) -> DataFrame:
    """Rows of some trees go to one."""
    return points.withColumn("treeID", F.when(F.col("treeID").isin(change), keep).otherwise(F.col("treeID")))


def range_asof(points: DataFrame, trajectory: DataFrame) -> DataFrame:
    """(point_id, range): distance to the trajectory (gpstime, x, y, z), interpolated at the point's gpstime.

    As-of by union: in one window per coarse time bucket would lose neighbours, so the last sample before and the first
    after are found by two equi-joins on buckets of the samples' own spans.
    """
    step = trajectory.agg(((F.max("gpstime") - F.min("gpstime")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("s")).first()["s"] or 1.0
    # the next sample: within stretches of a thousand samples' time by a window, and of the last one the next stretch's first
    wide, four = 1000 * float(step), ("gpstime", "x", "y", "z")
    t = trajectory.withColumn("_b", F.floor(F.col("gpstime") / wide))
    w = Window.partitionBy("_b").orderBy("gpstime")
    t = t.withColumns({f"{c}2": F.lead(c).over(w) for c in four})
    heads = t.groupBy("_b").agg(F.min(F.struct(*four)).alias("h")).withColumn("next", F.lead("h").over(Window.orderBy("_b")))  # a row a stretch
    spans = t.join(heads.select("_b", "next"), "_b").withColumns({f"{c}2": F.coalesce(f"{c}2", F.col("next")[c]) for c in four}).where("gpstime2 is not null")
    cut = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("gpstime") / step), F.floor(F.col("gpstime2") / step))))
    near = points.withColumn("b", F.floor(F.col("gpstime") / step)).withColumnRenamed("gpstime", "t").join(cut, "b").where("t >= gpstime and t < gpstime2")
    f = (F.col("t") - F.col("gpstime")) / (F.col("gpstime2") - F.col("gpstime"))
    at = [F.col(c) + f * (F.col(f"{c}2") - F.col(c)) for c in "xyz"]
    d = F.sqrt((F.col("X_") - at[0]) ** 2 + (F.col("Y_") - at[1]) ** 2 + (F.col("Z_") - at[2]) ** 2)
    return near.select("point_id", d.alias("range"))


def rename_xyz(points: DataFrame) -> DataFrame:
    return points.withColumnsRenamed({"X": "X_", "Y": "Y_", "Z": "Z_"})


def one_tree(points: DataFrame) -> DataFrame:
    """the wood of a cloud that holds one tree; more than one is an error."""
    if len(points.where("treeID is not null").select("treeID").distinct().limit(2).collect()) > 1:
        raise ValueError("the cloud holds more than one tree")
    return points.where("foliage = 0")


def of_tree(points: DataFrame, tree: int) -> DataFrame:
    """the points of one tree."""
    return points.where(F.col("treeID") == tree)


def gather(points: DataFrame, ids: DataFrame) -> DataFrame:
    """a row for each (point_id) of ids, repeats included."""
    return ids.select("point_id").join(points, "point_id")


def connected(points: DataFrame) -> DataFrame:
    """points whose distance to the root is known; -1 stands for unreachable."""
    return points.where("dist2root >= 0")


def highest_lowest(points: DataFrame) -> DataFrame:
    """(treeID, low, high): a tree's lowest and highest point, ties to the smaller point_id."""
    return points.groupBy("treeID").agg(F.min(F.struct("Z", "point_id"))["point_id"].alias("low"), (-F.max(F.struct("Z", (-F.col("point_id")).alias("m")))["m"]).alias("high"))


def wood_subset(points: DataFrame, trim: float = 0.01) -> DataFrame:
    """F8: wood above the lowest hundredth of its tree, and the tree's highest point."""
    span = points.groupBy("treeID").agg(F.min("Z").alias("_lo"), F.max("Z").alias("_hi")).join(highest_lowest(points).select("treeID", "high"), "treeID")
    wood = (F.col("foliage") == 0) & (F.col("Z") >= F.col("_lo") + (F.col("_hi") - F.col("_lo")) * trim)
    return points.join(span, "treeID").where(wood | (F.col("point_id") == F.col("high"))).drop("_lo", "_hi", "high")


def ground_seed(points: DataFrame, step: float = 0.05) -> DataFrame:
    """points of a tree below the first multiple of `step` that lies above its lowest point, which is `step` at least."""
    lo = points.groupBy("treeID").agg(F.min("Z").alias("_lo"))
    level = F.when(F.col("_lo") >= step, step * (F.floor(F.col("_lo") / step) + 1)).otherwise(step)
    return points.join(lo, "treeID").where(F.col("Z") < level).drop("_lo")


def bins(points: DataFrame, value: str, by: float) -> DataFrame:
    """P25: the points with `bin`: steps of `by` from a tree's least value rounded down, within its range."""
    span = points.groupBy("treeID").agg(F.floor(F.min(value)).alias("_lo"), F.ceil(F.max(value)).alias("_hi"))
    last = F.round((F.col("_hi") - F.col("_lo")) / by).cast("long") - 1
    raw = F.floor((F.col(value) - F.col("_lo") + 1e-9) / by)
    return points.join(span, "treeID").withColumn("bin", F.greatest(F.lit(0).cast("long"), F.least(raw, last))).drop("_lo", "_hi")


def merge_chunks(points: DataFrame) -> DataFrame:
    """Tree numbers of (chunk, treeID) raised by the largest numbers of the chunks before; the window holds a row a chunk."""
    top = points.groupBy("chunk").agg(F.coalesce(F.max("treeID"), F.lit(0)).alias("m"))
    before = top.select("chunk", F.coalesce(F.sum("m").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return points.join(before, "chunk").withColumn("treeID", F.when(F.col("treeID") > 0, F.col("treeID") + F.col("_o")).otherwise(F.col("treeID"))).drop("_o")


def filter_seeds(points: DataFrame) -> DataFrame:
    """low points that a path has passed."""
    return points.where("hag < 1 and passage > 0")


def first_colours(points: DataFrame) -> DataFrame:
    """(treeID, R, G, B) of each tree's first point by point_id."""
    return points.groupBy("treeID").agg(*[F.min_by(c, "point_id").alias(c) for c in "RGB"])


def colour_trees(points: DataFrame, darken: bool = True) -> DataFrame:
    """V9: R, G, B: grey, and for the TREE rows of a tree a colour that its id seeds, leaves at seven tenths of it."""
    from boscage.functions.geometry import hcl_to_rgb

    part = lambda salt, low, high: low + F.pmod(F.xxhash64("treeID", F.lit(salt)), F.lit(10_000)) / 10_000 * (high - low)
    own = (F.col("treeID") > 0) & (F.col("UserData") == TREE)
    shade = F.when(F.lit(darken) & (F.col("foliage") != 0), 0.7).otherwise(1.0)
    rgb = points.withColumn("_c", hcl_to_rgb(part(1, 0, 360), part(2, 40, 80), part(3, 50, 80)))
    return rgb.withColumns({c: F.when(own, F.floor(F.col(f"_c.{c.lower()}") * shade).cast("int")).otherwise(150) for c in "RGB"}).drop("_c")


def fix_small_isolated_low_clusters(points: DataFrame, res: float = 0.05, height: float = 3.0) -> DataFrame:
    """Of each tree's wood below `height`, all but the largest component (heights count a tenth) becomes foliage 1."""
    low = points.where((F.col("foliage") == 0) & (F.col("hag") < height) & F.col("treeID").isNotNull())
    lost = largest_component(low, res, "treeID", 0.1).where("not largest").select("point_id", F.lit(1).alias("_lost"))
    return points.join(lost, "point_id", "left").withColumn("foliage", F.when(F.col("_lost") == 1, F.lit(1).cast(dict(points.dtypes)["foliage"])).otherwise(F.col("foliage"))).select(*points.columns)


def clean_butt(points: DataFrame, height: float = 0.25, res: float = 0.05) -> DataFrame:
    """Of each tree's lowest `height` metres only the largest component stays."""
    least = points.groupBy("treeID").agg(F.min("Z").alias("_low"))
    butt = points.join(least, "treeID").where(F.col("Z") <= F.col("_low") + height)
    lost = largest_component(butt, res, "treeID").where("not largest").select("point_id")
    return points.join(lost, "point_id", "left_anti")
