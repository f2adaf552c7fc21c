"""Ground filter and terrain, tile by tile with a halo.

A tile's surfaces are numpy in one Arrow task, from the lowest points of its finest cells, whose number is bounded by the
tile's area; however many points a tile has, they only meet its surfaces in joins.
The filter refines lowest points from coarse to fine cells, as the published progressive densification does, over bilinear
surfaces instead of triangles: each finer cell's lowest point is ground if it rises above the surface of the coarser ones
by no more than the allowed angle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boscage.operators._state import cut
from boscage.operators.spatial import nearest_ground, tiles

#: Classes of points.
UNCLASSIFIED, GROUND = 1, 2
#: Rows of surfaces up to which every task gets them; more are shuffled.
BROADCAST = 200_000


def surface(x: np.ndarray, y: np.ndarray, z: np.ndarray, size: float) -> tuple[np.ndarray, float, float]:
    """(grid of heights, left, lower) of lowest points by cells; empty cells take the mean of their filled neighbours."""
    left, lower = np.floor(x.min() / size) * size, np.floor(y.min() / size) * size
    i, j = ((x - left) / size).astype(int), ((y - lower) / size).astype(int)
    grid = np.full((i.max() + 1, j.max() + 1), np.inf)
    np.minimum.at(grid, (i, j), z)
    grid[np.isinf(grid)] = np.nan
    return filled(grid), left, lower


def filled(grid: np.ndarray) -> np.ndarray:
    """The grid whose empty cells (not a number) take the mean of their filled neighbours, round by round."""
    while np.isnan(grid).any():
        around = np.pad(grid, 1, constant_values=np.nan)
        nine = np.stack([around[a : a + grid.shape[0], b : b + grid.shape[1]] for a in range(3) for b in range(3)])
        known = ~np.isnan(nine)
        mean = np.where(known, nine, 0).sum(0) / np.maximum(known.sum(0), 1)
        grid = np.where(np.isnan(grid) & known.any(0), mean, grid)
    return grid


def heights(grid: np.ndarray, left: float, lower: float, size: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear heights between the cells' centres."""
    u = np.clip((x - left) / size - 0.5, 0, grid.shape[0] - 1)
    v = np.clip((y - lower) / size - 0.5, 0, grid.shape[1] - 1)
    i, j = np.minimum(u.astype(int), max(grid.shape[0] - 2, 0)), np.minimum(v.astype(int), max(grid.shape[1] - 2, 0))
    i2, j2 = np.minimum(i + 1, grid.shape[0] - 1), np.minimum(j + 1, grid.shape[1] - 1)
    f, g = u - i, v - j
    return (1 - f) * (1 - g) * grid[i, j] + f * (1 - g) * grid[i2, j] + (1 - f) * g * grid[i, j2] + f * g * grid[i2, j2]


def _sizes(coarse: float, spacing: float) -> list[float]:
    """Cell sizes of the filter: halves of the coarse one, down to the spacing."""
    sizes = [coarse]
    while sizes[-1] > spacing:
        sizes.append(max(sizes[-1] / 2, spacing))
    return sizes


def lowest_mask(x: np.ndarray, y: np.ndarray, z: np.ndarray, coarse: float = 5.0, spacing: float = 0.1, angle: float = 30.0, distance: float = 2.0) -> np.ndarray:
    """Which points are lowest of a cell and rise from the coarser cells' surface by no more than allowed."""
    ground = np.zeros(len(z), bool)
    for size in _sizes(coarse, spacing):
        cell = np.floor(x / size) * 4_000_037 + np.floor(y / size)
        order = np.lexsort((y, x, z, cell))
        low = order[np.flatnonzero(np.append(True, np.diff(cell[order]) != 0))]
        if size < coarse:
            grid, left, lower = surface(x[ground], y[ground], z[ground], 2 * size)
            rise = z[low] - heights(grid, left, lower, 2 * size, x[low], y[low])
            low = low[(rise <= min(distance, math.tan(math.radians(angle)) * size)) & (rise >= -distance)]
        ground[low] = True
    return ground


def ground_mask(x: np.ndarray, y: np.ndarray, z: np.ndarray, coarse: float = 5.0, spacing: float = 0.1, angle: float = 30.0, distance: float = 2.0) -> np.ndarray:
    """Which points are ground."""
    ground = lowest_mask(x, y, z, coarse, spacing, angle, distance)
    grid, left, lower = surface(x[ground], y[ground], z[ground], max(4 * spacing, 0.5))
    return ground | (np.abs(z - heights(grid, left, lower, max(4 * spacing, 0.5), x, y)) <= spacing / 2)


#: What a tile's task tells: its surface's place and size, four heights around each (i, j), and places of lowest points.
_SURFACE = "tx long, ty long, what string, _left double, _lower double, _nx long, _ny long, _i long, _j long, _a double, _b double, _c double, _d double, X double, Y double, Z double"


def _told(tile: tuple, what: str, n: int, **columns: np.ndarray | float | int) -> pa.Table:
    """n rows of _SURFACE; columns that aren't told are null."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    own = {"tx": tile[0], "ty": tile[1], "what": what, **columns}
    fields = [f.split() for f in _SURFACE.split(", ")]
    return pa.table({c: pa.array(np.broadcast_to(own[c], n) if c != "what" else [what] * n, kinds[k]) if c in own else pa.nulls(n, kinds[k]) for c, k in fields})


def _corners(tile: tuple, grid: np.ndarray, left: float, lower: float) -> pa.Table:
    """A surface as rows: one of its place, and the four heights that a place between cells' centres (i, j) lies among."""
    nx, ny = grid.shape
    i, j = (a.ravel() for a in np.meshgrid(np.arange(max(nx - 1, 1)), np.arange(max(ny - 1, 1)), indexing="ij"))
    i2, j2 = np.minimum(i + 1, nx - 1), np.minimum(j + 1, ny - 1)
    place = _told(tile, "place", 1, _left=left, _lower=lower, _nx=nx, _ny=ny)
    return pa.concat_tables([place, _told(tile, "four", len(i), _i=i, _j=j, _a=grid[i, j], _b=grid[i2, j], _c=grid[i, j2], _d=grid[i2, j2])])


def _shared(told: DataFrame) -> DataFrame:
    return F.broadcast(told) if told.count() <= BROADCAST else told


def _with_height(points: DataFrame, told: DataFrame, size: float, name: str) -> DataFrame:
    """Tiled points with the height of their tile's surface, bilinear as heights()."""
    t = points.join(_shared(told.where("what = 'place'").select("tx", "ty", "_left", "_lower", "_nx", "_ny")), ["tx", "ty"])
    for u, i, a, low, n in (("_u", "_i", "X", "_left", "_nx"), ("_v", "_j", "Y", "_lower", "_ny")):
        t = t.withColumn(u, F.greatest(F.lit(0.0), F.least(F.col(n) - F.lit(1.0), (F.col(a) - F.col(low)) / size - 0.5)))
        t = t.withColumn(i, F.least(F.floor(u), F.greatest(F.col(n) - 2, F.lit(0))).cast("long"))
    t = t.withColumns({"_f": F.col("_u") - F.col("_i"), "_g": F.col("_v") - F.col("_j")})
    t = t.join(_shared(told.where("what = 'four'").select("tx", "ty", "_i", "_j", "_a", "_b", "_c", "_d")), ["tx", "ty", "_i", "_j"])
    f, g = F.col("_f"), F.col("_g")
    at = (1 - f) * (1 - g) * F.col("_a") + f * (1 - g) * F.col("_b") + (1 - f) * g * F.col("_c") + f * g * F.col("_d")
    return t.select(*points.columns, at.alias(name))


def segment_ground(points: DataFrame, size: float = 50.0, halo: float = 10.0, coarse: float = 5.0, spacing: float = 0.1, angle: float = 30.0, distance: float = 2.0) -> DataFrame:
    """V1: points with Classification (ground 2, others 1) and hag, the height above the surface of the tile's ground.

    A tile sees the points within `halo` of it and tells of its own.  A cloud without points stays empty.  The lowest points
    of all cells are among those of the finest ones: a coarser cell is four of the next finer, but for the spacing's own.
    """
    names = [c for c in points.columns if c not in ("Classification", "hag")]
    own = points.select(F.floor(F.col("X") / size).alias("tx"), F.floor(F.col("Y") / size).alias("ty")).distinct()
    tiled = tiles(points.select(*names), size, halo).join(_shared(cut(own)), ["tx", "ty"], "left_semi")
    sizes, near, flat = _sizes(coarse, spacing), max(4 * spacing, 0.5), max(2 * spacing, 0.2)
    finest = sizes[-1:] if len(sizes) == 1 or sizes[-1] * 2 == sizes[-2] else sizes[-2:]

    def lowest(s: float) -> DataFrame:
        cells = tiled.where("not isnan(Z)").groupBy("tx", "ty", F.floor(F.col("X") / s).alias("i"), F.floor(F.col("Y") / s).alias("j"))
        return cells.agg(F.min(F.struct("Z", "X", "Y")).alias("p")).select("tx", "ty", *[F.col(f"p.{a}").cast("double").alias(a) for a in "XYZ"])

    def first(tile: tuple, table: pa.Table) -> pa.Table:
        x, y, z = (np.asarray(table[a]) for a in "XYZ")
        low = lowest_mask(x, y, z, coarse, spacing, angle, distance)
        x, y, z = x[low], y[low], z[low]
        tile = tuple(k.as_py() for k in tile)
        return pa.concat_tables([_corners(tile, *surface(x, y, z, near)), _told(tile, "low", len(x), X=x, Y=y, Z=z)])

    def second(tile: tuple, table: pa.Table) -> pa.Table:
        i, j = np.asarray(table["_i"]), np.asarray(table["_j"])
        grid = np.full((i.max() + 1, j.max() + 1), np.nan)
        grid[i, j] = np.asarray(table["Z"])
        return _corners(tuple(k.as_py() for k in tile), filled(grid), table["_left"][0].as_py(), table["_lower"][0].as_py())

    found = lowest(finest[0])
    for s in finest[1:]:
        found = found.unionByName(lowest(s))
    told = cut(found.distinct().groupBy("tx", "ty").applyInArrow(first, _SURFACE))
    low = told.where("what = 'low'").select("tx", "ty", *"XYZ").distinct().withColumn("_low", F.lit(True))
    marked = _with_height(tiled, told, near, "_at").join(_shared(low), ["tx", "ty", *"XYZ"], "left")
    marked = marked.withColumn("_ground", F.coalesce("_low", F.lit(False)) | (~F.isnan("Z") & (F.abs(F.col("Z") - F.col("_at")) <= spacing / 2)))
    ground = marked.where("_ground").select("tx", "ty", *"XYZ")
    place = cut(ground.groupBy("tx", "ty").agg(*[(F.floor(F.min(a) / flat) * flat).alias(n) for a, n in (("X", "_left"), ("Y", "_lower"))]))
    at = ground.join(_shared(place), ["tx", "ty"]).withColumns({i: ((F.col(a) - F.col(n)) / flat).cast("long") for i, a, n in (("_i", "X", "_left"), ("_j", "Y", "_lower"))})
    cells = at.groupBy("tx", "ty", "_left", "_lower", "_i", "_j").agg(F.min("Z").cast("double").alias("Z"))
    over = cut(cells.groupBy("tx", "ty").applyInArrow(second, _SURFACE))
    kind = F.when(F.col("_ground"), GROUND).otherwise(UNCLASSIFIED).cast("int")
    out = _with_height(marked.where("core"), over, flat, "_at2")
    return out.select(*names, kind.alias("Classification"), (F.col("Z") - F.col("_at2")).alias("hag"))


def dtm(points: DataFrame, res: float = 0.1) -> DataFrame:
    """V2: (row, col, x, y, z): mean height of the ground points of each cell of the cloud's box; a cell without any takes that
    of the nearest ground point in x and y (J6)."""
    ground = points.where(F.col("Classification") == GROUND)
    box = points.agg(*[f(a).alias(n + a) for n, f in (("lo", F.min), ("hi", F.max)) for a in "XY"]).first()
    if box["loX"] is None:
        return points.sparkSession.createDataFrame([], "row long, col long, x double, y double, z double")
    cols, rows = int((box["hiX"] - box["loX"]) / res) + 1, int((box["hiY"] - box["loY"]) / res) + 1
    cells = points.sparkSession.range(rows * cols).select(F.col("id").alias("point_id"), F.expr(f"id div {cols}").alias("row"), (F.col("id") % cols).alias("col"))
    cells = cells.withColumns({"X": box["loX"] + (F.col("col") + 0.5) * res, "Y": box["loY"] + (F.col("row") + 0.5) * res, "Z": F.lit(0.0)})
    mean = ground.groupBy(F.floor((F.col("Y") - box["loY"]) / res).alias("row"), F.floor((F.col("X") - box["loX"]) / res).alias("col")).agg(F.avg("Z").alias("mean"))
    with_mean = cells.join(mean, ["row", "col"], "left")
    bare = nearest_ground(with_mean.where("mean is null").select("point_id", "X", "Y", "Z"), ground)
    filled = with_mean.join(bare, "point_id", "left")
    return filled.select("row", "col", F.col("X").alias("x"), F.col("Y").alias("y"), F.coalesce("mean", "ground").alias("z"))


def single_tree_ground(points: DataFrame, n: int = 1000, seed: int = 1) -> DataFrame:
    """The points and n ground points at their least height, spread evenly at random over their box and a metre around."""
    box = points.agg(*[f(a).alias(k + a) for k, f in (("lo", F.min), ("hi", F.max)) for a in "XY"], F.min("Z").alias("loZ"), F.max("point_id").alias("last"))
    even = lambda a, s: (F.col(f"lo{a}") - 1 + F.rand(s) * (F.col(f"hi{a}") - F.col(f"lo{a}") + 2)).alias(a)
    made = points.sparkSession.range(n).crossJoin(F.broadcast(box)).where("loZ is not null")  # one row
    new = made.select((F.col("last") + 1 + F.col("id")).alias("point_id"), even("X", seed), even("Y", seed + 1), F.col("loZ").alias("Z"), F.lit(GROUND).alias("Classification"), F.lit(1).alias("ReturnNumber"))
    return points.unionByName(new, allowMissingColumns=True)
