"""Spatial joins on a grid hash: radius join, certified k-nearest join, 1-NN transfer.

A join explodes the queries over the 27 cells around theirs and equi-joins on the cell, so it is an ordinary shuffled
join whose skewed cells AQE splits; there is no cross join.  Queries whose neighbours lie beyond those cells look into
blocks of points instead; the boxes of at most MOST_BLOCKS blocks go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boscage.operators._state import cut

def _around():
    return F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(c).cast("long").alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
def _d2():
    return (F.col("qx") - F.col("X")) ** 2 + (F.col("qy") - F.col("Y")) ** 2 + (F.col("qz") - F.col("Z")) ** 2


def _cells(df: DataFrame, x: str, y: str, z: str, size: float) -> DataFrame:
    return df.withColumns({n: F.floor(F.col(c) / size).cast("long") for n, c in (("cx", x), ("cy", y), ("cz", z))})


def neighbours(queries: DataFrame, points: DataFrame, size: float, columns: tuple[str, ...] = ()) -> DataFrame:
    """(qid, point_id, d2, *columns) of all points in the 27 cells around each query: everything within `size` at least."""
    q = queries.select(F.col("point_id").alias("qid"), F.col("X").alias("qx"), F.col("Y").alias("qy"), F.col("Z").alias("qz"))
    q = _cells(q, "qx", "qy", "qz", size).withColumn("o", F.explode(_around()))
    q = q.select("qid", "qx", "qy", "qz", *((F.col(c) + F.col("o")[o]).alias(c) for c, o in (("cx", "a"), ("cy", "b"), ("cz", "c"))))
    p = _cells(points.select("point_id", "X", "Y", "Z", *columns), "X", "Y", "Z", size)
    return q.join(p, ["cx", "cy", "cz"]).select("qid", "point_id", _d2().alias("d2"), *columns)


def radius_join(queries: DataFrame, points: DataFrame, r: float, columns: tuple[str, ...] = ()) -> DataFrame:
    """(qid, point_id, d2) of points strictly nearer than r."""
    return neighbours(queries, points, r, columns).where(F.col("d2") < r * r)


def spacing(points: DataFrame, k: int) -> tuple[float, float]:
    """(cell size whose 27 cells hold about 3k points, extent) from one aggregation."""
    b = points.agg(F.count("*").alias("n"), *[F.max(a).alias(f"h{a}") for a in "XYZ"], *[F.min(a).alias(f"l{a}") for a in "XYZ"]).first()
    if not b["n"]:
        return 1.0, 0.0
    spans = [max(b[f"h{a}"] - b[f"l{a}"], 1e-9) for a in "XYZ"]
    extent = max(spans)
    v = 1.0
    for s in spans:
        v *= max(s, extent * 1e-3)
    return max((v * 3 * k / b["n"] / 27) ** (1 / 3), extent * 1e-4, 1e-9), extent


#: Points of a sample that places the blocks, points a block is meant to hold, most blocks; they rule the work, not the result.
SAMPLE, BLOCK, MOST_BLOCKS = 200_000, 256, 16_384


def _planes(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, value) of the planes that halve a sample `depth` times along its longest side; node i has 2i and 2i + 1 below."""
    axis, value = np.zeros(2**depth, int), np.zeros(2**depth)
    parts = {1: sample}
    for i in range(1, 2**depth):
        x = parts.pop(i)
        if len(x):
            axis[i] = np.ptp(x, axis=0).argmax()
            value[i] = np.median(x[:, axis[i]])
        above = x[:, axis[i]] >= value[i]
        parts[2 * i], parts[2 * i + 1] = x[~above], x[above]
    return axis, value


def _gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(points, boxes): squared distances from points to boxes; 0 within."""
    out = np.zeros((len(x), len(low)))
    for a in range(3):
        out += np.maximum(np.maximum(low[:, a] - x[:, a, None], x[:, a, None] - high[:, a]), 0) ** 2
    return out


def _xyz(batch: pa.RecordBatch, names: str = "XYZ") -> np.ndarray:
    return np.stack([np.asarray(batch[c].cast(pa.float64()).fill_null(np.nan)) for c in names], 1)


def blocks(points: DataFrame, n: int, size: int = BLOCK) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(points with `block`, (low, high, number of points) of each block): blocks of about as many of the n points each.

    A bounded sample places the planes between blocks, every point is in one.  Points without a place are left out.
    """
    depth = max(min(n // size, MOST_BLOCKS), 1).bit_length() - 1
    points = points.where(" and ".join(f"{a} is not null and not isnan({a})" for a in "XYZ"))
    some = points.select(*"XYZ") if n <= SAMPLE else points.select(*"XYZ").sample(SAMPLE / n, 1)
    axis, value = _planes(_xyz(some.limit(2 * SAMPLE).toArrow()), depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, node = _xyz(batch), np.ones(batch.num_rows, int)
            for _ in range(depth):
                node = 2 * node + (x[np.arange(len(x)), axis[node]] >= value[node])
            yield batch.append_column("block", pa.array(node - 2**depth, pa.int64()))

    dealt = cut(points.mapInArrow(run, T.StructType([*points.schema, T.StructField("block", T.LongType())])))
    rows = dealt.groupBy("block").agg(F.count("*").alias("n"), *[f(a).alias(f"{e}{a}") for e, f in (("l", F.min), ("h", F.max)) for a in "XYZ"]).toArrow()
    low, high, count = np.zeros((2**depth, 3)) + np.inf, np.zeros((2**depth, 3)) - np.inf, np.zeros(2**depth, int)
    at = np.asarray(rows["block"])
    low[at], high[at], count[at] = _xyz(rows, ("lX", "lY", "lZ")), _xyz(rows, ("hX", "hY", "hZ")), np.asarray(rows["n"])
    return dealt, (low, high, count)


#: Nodes that a block of a graph is meant to hold; it rules the work, not the result.
NODES = 16_384


def places(points: DataFrame) -> DataFrame:
    """(node, block) of points, for graph.shortest_paths(): blocks of points that lie together."""
    return blocks(points.select("point_id", *"XYZ"), points.count(), NODES)[0].select(F.col("point_id").alias("node"), "block")


def _first_blocks(gap: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, block) of each query's nearest blocks, as many as hold k points together."""
    near = min(16, len(count))
    while True:
        order = np.argpartition(gap, near - 1, axis=1)[:, :near] if near < len(count) else np.tile(np.arange(len(count)), (len(gap), 1))
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(gap, order, 1), axis=1, kind="stable"), 1)
        held = np.cumsum(count[order], axis=1)
        if near == len(count) or (held[:, -1] >= k).all():
            break
        near = min(near * 4, len(count))
    query, place = np.nonzero((held - count[order] < k) & np.isfinite(np.take_along_axis(gap, order, 1)))
    return query, order[query, place]


def _best(pairs: DataFrame, dealt: DataFrame, k: int, columns: tuple[str, ...]) -> DataFrame:
    """The k nearest points of each query among those of its blocks that are no farther than `far`."""
    t = pairs.join(dealt, "block").where(_d2() <= F.col("far")).select("qid", "point_id", _d2().alias("d2"), *columns)
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d2", "point_id"))).where(F.col("rank") <= k)


def knn_by_blocks(queries: DataFrame, points: DataFrame, n: int, k: int, columns: tuple[str, ...] = ()) -> DataFrame:
    """knn_join() for queries that lie far from the n points, or among few of them; exact.

    The k-th distance within a query's nearest blocks bounds how far the others that it has to look into may lie.
    """
    dealt, (low, high, count) = blocks(points.select(*dict.fromkeys(("point_id", "X", "Y", "Z", *columns))), n)
    kind = queries.schema["point_id"].dataType.simpleString()
    rows = max(1, 2_000_000 // len(count))
    tasks = min(queries.count() * len(count) // 10_000_000 + 1, 2_000)  # by work, which rows and bytes do not tell

    def pairs(bounded: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, rows):
                    batch = whole.slice(at, rows)
                    x = _xyz(batch, ("qx", "qy", "qz"))
                    gap = _gaps(x, low, high)
                    query, block = _first_blocks(gap, count, k)
                    if bounded:
                        within = gap <= np.asarray(batch["far"])[:, None] * (1 + 1e-12)
                        within[query, block] = False  # looked into before
                        query, block = np.nonzero(within)
                    out = batch.select(["qid", "qx", "qy", "qz", "far"]).take(pa.array(query, pa.int64()))
                    yield out.append_column("block", pa.array(block, pa.int64()))

        return run

    schema = f"qid {kind}, qx double, qy double, qz double, far double, block long"
    q = queries.select(F.col("point_id").alias("qid"), *[F.col(a).cast("double").alias(f"q{a.lower()}") for a in "XYZ"]).repartition(tasks, "qid")
    first = cut(_best(q.withColumn("far", F.lit(float("inf"))).mapInArrow(pairs(False), schema), dealt, k, columns).drop("rank"))
    # with fewer than k found there are fewer than k points, all of them found
    far = first.groupBy("qid").agg(F.max("d2").alias("far"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
    more = _best(q.join(far, "qid").repartition(tasks, "qid").mapInArrow(pairs(True), schema), dealt, k, columns).drop("rank")
    order = Window.partitionBy("qid").orderBy("d2", "point_id")
    return first.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_join(queries: DataFrame, points: DataFrame, k: int, columns: tuple[str, ...] = (), size: float | None = None) -> DataFrame:
    """(qid, point_id, d2, rank, *columns): the k nearest points, ties to the smaller point_id; exact.

    A query is settled when its k-th distance is within the cell size, which its 27 cells cover on every side; the others
    lie far from the points or among few, and go on by blocks of points.  With fewer than k points, fewer rows come back.
    """
    cell, _ = spacing(points, k)
    extent = spacing(points.select("X", "Y", "Z").unionByName(queries.select("X", "Y", "Z")), k)[1]  # queries may lie outside the cloud
    cell = size or cell
    todo = queries.select("point_id", "X", "Y", "Z")
    order = Window.partitionBy("qid").orderBy("d2", "point_id")
    best = neighbours(todo, points, cell, columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if cell >= extent:
        return best
    every = Window.partitionBy("qid")
    best = best.withColumn("sure", (F.count("*").over(every) == k) & (F.max("d2").over(every) <= cell * cell))
    done = cut(best.where("sure").drop("sure"))
    todo = cut(todo.join(done.select(F.col("qid").alias("point_id")).distinct(), "point_id", "left_anti"))
    if todo.isEmpty():
        return done
    return done.unionByName(knn_by_blocks(todo, points, points.count(), k, columns).select(*done.columns))


def nearest(queries: DataFrame, points: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """(qid, point_id, d2, *columns) of each query's nearest point."""
    return knn_join(queries, points, 1, columns).drop("rank")


def transfer_attributes(source: DataFrame, target: DataFrame, attributes: list[str]) -> DataFrame:
    """Every target row with the attributes of the nearest source row; same-named columns are replaced."""
    found = nearest(target, source, tuple(attributes)).select(F.col("qid").alias("point_id"), *attributes)
    return target.drop(*attributes).join(found, "point_id", "left")


def nearest_ground(queries: DataFrame, ground: DataFrame) -> DataFrame:
    """(point_id, ground): height of the ground point nearest in x and y; 0.0 where there is no ground at all."""
    flat = lambda df, *more: df.select("point_id", "X", "Y", F.lit(0.0).alias("Z"), *more)
    found = nearest(flat(queries), flat(ground, F.col("Z").alias("ground")), ("ground",)).select(F.col("qid").alias("point_id"), "ground")
    return queries.select("point_id").join(found, "point_id", "left").withColumn("ground", F.coalesce("ground", F.lit(0.0)))


def tree_context_knn(points: DataFrame, tree: int, k: int = 20) -> DataFrame:
    """Ids of the points of all trees that are among the k nearest neighbours of one of the tree's points."""
    own = points.where(F.col("treeID") == tree)
    touched = knn_join(own, points.where(F.col("treeID") > 0), k, ("treeID",)).select("treeID").distinct()
    return points.join(touched, "treeID", "left_semi").select("point_id")


def tiles(points: DataFrame, size: float = 50.0, halo: float = 10.0) -> DataFrame:
    """The points once for each tile (tx, ty) whose square they lie in or within `halo` of; `core`: in the square itself."""
    out = points
    for t, a in (("tx", "X"), ("ty", "Y")):
        near = F.sequence(F.floor((F.col(a) - halo) / size), F.floor((F.col(a) + halo) / size))
        out = out.withColumn(t, F.explode(near))
    core = (F.floor(F.col("X") / size) == F.col("tx")) & (F.floor(F.col("Y") / size) == F.col("ty"))
    return out.withColumn("core", core)


def trees_of_tile(points: DataFrame, seeds: DataFrame, size: float = 50.0) -> DataFrame:
    """Of tiled points, those of trees whose seeds' mean place lies in the tile's own square.

    Means may lie on a square's edge, where the last digit of a sum decides: seeds are added up in the order of their
    point_id, one by one, so that the result depends neither on partitions nor on the order they are read in.
    """
    w = Window.partitionBy("treeID", "tx", "ty").orderBy("point_id")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    home = seeds.where("treeID > 0").select("treeID", "tx", "ty", *[F.avg(a).over(run).alias(a.lower()) for a in "XY"], F.lead(F.lit(1)).over(w).isNull().alias("last")).where("last")
    home = home.where((F.floor(F.col("x") / size) == F.col("tx")) & (F.floor(F.col("y") / size) == F.col("ty")))
    return points.join(home, ["treeID", "tx", "ty"], "left_semi")


def tree_context(points: DataFrame, tree: int, r: float = 0.1) -> DataFrame:
    """Ids of the points of all trees that have a point within r of the tree's."""
    own = points.where(F.col("treeID") == tree)
    touched = radius_join(own, points.where(F.col("treeID") > 0), r, ("treeID",)).select("treeID").distinct()
    return points.join(touched, "treeID", "left_semi").select("point_id")


def model_distances(points: DataFrame, cylinders: DataFrame, k: int) -> DataFrame:
    """(point_id, cyl_ID, dist, radius): the nearest of the k cylinders whose midpoints are nearest."""
    from boscage.functions.geometry import with_surface_distance

    shape = ("startX", "startY", "startZ", "endX", "endY", "endZ", "radius")
    middle = cylinders.select(F.col("cyl_ID").alias("point_id"), *((F.col(f"start{a}") / 2 + F.col(f"end{a}") / 2).alias(a) for a in "XYZ"), *shape)
    near = knn_join(points, middle, k, shape).withColumnRenamed("point_id", "cyl_ID").join(points.select(F.col("point_id").alias("qid"), F.col("X").alias("px"), F.col("Y").alias("py"), F.col("Z").alias("pz")), "qid")
    near = with_surface_distance(near, "px", "py", "pz")
    return near.groupBy("qid").agg(F.min(F.struct("dist", "cyl_ID", "radius")).alias("b")).select(F.col("qid").alias("point_id"), "b.cyl_ID", "b.dist", "b.radius")
