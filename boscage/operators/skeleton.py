"""Tree models: skeleton, smoothing, pipe model and prolongation.

Each step is sequential within a tree and independent between trees, so it is numpy in one task a tree, smoothing over batches of
whole trees at once; a tree is bounded by nature (thousands of cylinders), the forest is not.  Cylinder tables are keyed by (tree_id, cyl_ID); a cylinder whose
parent_ID is no cylinder of its tree starts at the root.  Null radii are unset.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boscage.operators.folds import by_tree, parents

#: Shrink and inflate factors for places and for radii, rounds for radii.
SHRINK, INFLATE_PLACES, INFLATE_RADII, RADII_STEPS = 0.5, -0.53, -0.7, 15
#: Quality of a radius that was prolonged and of one that came from allometry.
PROLONGED, ALLOMETRIC = 1, 2
#: Runs from which on they are swept together rather than one by one.
FEW = 16


def taubin(v: np.ndarray, steps: int, inflate: float, floor: float = 0.0) -> np.ndarray:
    """v (n x d) after rounds of a shrinking and an inflating sweep; each sweep uses values it has changed already.

    The ends stay.  Rows are swept in order because a row depends on the changed row before it.
    """
    columns = np.asarray(v, float).T.tolist()
    for x in columns:
        for factor in (SHRINK, inflate) * (steps if len(x) > 2 else 0):
            for i in range(1, len(x) - 1):
                x[i] += factor * (0.5 * (x[i - 1] + x[i + 1]) - x[i])
                if floor > 0:
                    x[i] = max(x[i], floor)
    return np.array(columns).reshape(np.shape(v)[::-1]).T


def taubins(v: np.ndarray, first: np.ndarray, size: np.ndarray, steps: np.ndarray, inflate: float, floor: np.ndarray) -> np.ndarray:
    """taubin() of many runs of rows at once, each from `first` on, `size` long, with its own rounds and floor."""
    v, order = np.array(v, float), np.argsort(-size, kind="stable")
    if len(size) < FEW:
        for at, n, rounds, low in zip(first.tolist(), size.tolist(), steps.tolist(), floor.tolist(), strict=True):
            v[at : at + n] = taubin(v[at : at + n], rounds, inflate, low)
        return v
    first, size, steps, floor = (x[order] for x in (first, size, steps, floor))
    todo = (size > 2) & (steps > 0)
    for n in range(int(steps[todo].max(initial=0))):
        live = todo & (steps > n)
        at, low = first[live], floor[live]
        # runs by falling size: those with a row left at a place are the first of them
        inner = np.searchsorted(-size[live], -np.arange(2, size[live].max()), side="left")
        for factor in (SHRINK, inflate):
            for i, many in enumerate(inner.tolist(), 1):
                row = at[:many] + i
                new = v[row] + factor * (0.5 * (v[row - 1] + v[row + 1]) - v[row])
                v[row] = np.where(low[:many, None] > 0, np.maximum(new, low[:many, None]), new)
    return v


def _axes(t: pd.DataFrame, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, first, size): the rows of each axis from base to tip, axes by tree and number; rows without an axis are in none."""
    axis, ident = t["axis_ID"].to_numpy(), t["cyl_ID"].to_numpy()
    rows = np.flatnonzero(t["axis_ID"].notna().to_numpy())
    rows = rows[np.lexsort((ident[rows], -t["subtree_length"].to_numpy(float)[rows], axis[rows], tree[rows]))]
    first = np.flatnonzero(np.append(True, (np.diff(tree[rows]) != 0) | (np.diff(axis[rows]) != 0))[: len(rows)])
    return rows, first, np.diff(np.append(first, len(rows)))


def _by_batch(cylinders: DataFrame, need: list[str], change: list[str], run) -> DataFrame:
    """cylinders with columns replaced by those of run(needed columns, number of each row's tree); not-a-number becomes null."""

    def replaced(table: pa.Table, tree: np.ndarray) -> pa.Table:
        new = run(table.select(need).to_pandas(), tree)
        for c in change:
            i = table.schema.get_field_index(c)
            table = table.set_column(i, table.schema.field(i), pa.array(new[c].to_numpy(float), from_pandas=True).cast(table.schema.field(i).type))
        return table

    return by_tree(cylinders, replaced, cylinders.schema)


def places_smoothed(t: pd.DataFrame, steps: int, tree: np.ndarray | None = None) -> pd.DataFrame:
    """smooth_skeleton() of one tree, or of whole trees whose numbers are told.

    An axis's base may be a place of an axis before it, so trees go together axis by axis.
    """
    tree = np.zeros(len(t), int) if tree is None else tree
    end, start = _ends(t)
    ident, above = t["cyl_ID"].to_numpy(np.int64), t["parent_ID"].fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
    parent = parents(ident, above, tree, last=True) if len(t) else above
    rows, first, size = _axes(t, tree)
    if steps > 0 and len(first):
        rank = np.arange(len(first)) - np.searchsorted(tree[rows[first]], tree[rows[first]])  # an axis's place in its tree
        rounds = np.maximum(2, np.floor(steps * 0.75 ** (t["branch_order"].to_numpy(float)[rows[first]] - 1)))
        by_rank = np.argsort(rank, kind="stable")
        by_rank = by_rank[size[by_rank] >= 3]
        for own in np.split(by_rank, np.flatnonzero(np.diff(rank[by_rank])) + 1) if len(by_rank) else ():
            head = rows[first[own]]
            at = np.cumsum(size[own] + 1) - size[own] - 1
            inner = np.ones(int((size[own] + 1).sum()), bool)
            inner[at] = False
            row = rows[np.repeat(first[own] - (at - np.arange(len(own))), size[own]) + np.arange(int(size[own].sum()))]
            v = np.empty((len(inner), 3))
            v[at], v[inner] = np.where((parent[head] < 0)[:, None], start[head], end[parent[head]]), end[row]
            end[row] = taubins(v, at, size[own] + 1, rounds[own].astype(int), INFLATE_PLACES, np.zeros(len(own)))[inner]
    start = np.where((parent >= 0)[:, None], end[parent], start)
    places = {f"{e}{a}": x[:, i] for e, x in (("end", end), ("start", start)) for i, a in enumerate("XYZ")}
    return pd.DataFrame({c: places[c] if c in places else t[c].to_numpy() for c in t.columns}, copy=False)


def smooth_skeleton(cylinders: DataFrame, steps: int = 15) -> DataFrame:
    """Places of axes of three cylinders or more, smoothed; rounds fall by a quarter each branch order, to two at least.

    A place belongs to the cylinder that ends there, so cylinders that start there move along.
    """
    places = [f"{e}{a}" for e in ("start", "end") for a in "XYZ"]
    return _by_batch(cylinders, ["cyl_ID", "parent_ID", "axis_ID", "branch_order", "subtree_length", *places], places, lambda t, tree: places_smoothed(t, steps, tree))


def radii_smoothed(t: pd.DataFrame, tree: np.ndarray | None = None) -> pd.DataFrame:
    """smooth_radii() of one tree, or of whole trees whose numbers are told."""
    t = t.reset_index(drop=True)
    r = t["radius"].to_numpy(float).copy()
    rows, first, size = _axes(t, np.zeros(len(t), int) if tree is None else tree)
    if len(first):
        least = np.minimum.reduceat(r[rows], first)  # not a number, if one is unset
        steps = np.where(np.isnan(least), 0, RADII_STEPS)
        r[rows] = taubins(r[rows][:, None], first, size, steps, INFLATE_RADII, np.maximum(0.5 * least, 1e-4))[:, 0]
    t["radius"] = r
    return t


def smooth_radii(cylinders: DataFrame) -> DataFrame:
    """Radii of axes of three cylinders or more whose radii are all set; never below half the least, the tip's stays."""
    return _by_batch(cylinders, ["cyl_ID", "axis_ID", "subtree_length", "radius"], ["radius"], radii_smoothed)


def _ends(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    end, start = (np.stack([t[f"{e}{a}"].to_numpy(float) for a in "XYZ"], 1) for e in ("end", "start"))
    return end, start


def _per_tree(cylinders: DataFrame, run, schema=None) -> DataFrame:
    return cylinders.groupBy("tree_id").applyInPandas(run, schema or cylinders.schema)


def piped(t: pd.DataFrame, tip: float) -> pd.DataFrame:
    t = t.reset_index(drop=True)
    ids = set(t["cyl_ID"])
    children: dict = {}
    for i, p in enumerate(t["parent_ID"]):
        children.setdefault(p if p in ids else None, []).append(i)
    r, s, ident = t["radius"].to_numpy(float).copy(), t["subtree_length"].to_numpy(float), t["cyl_ID"].tolist()
    quality = t["quality"].to_numpy().copy()
    todo = [(None, math.nan, 0.0)]
    while todo:
        node, anchor, reach = todo.pop()
        below = children.get(node, [])
        unset = [i for i in below if math.isnan(r[i])]
        share = math.sqrt(sum(s[i] ** 2 for i in below))
        for i in unset:
            if math.isnan(anchor) or reach <= 0:
                r[i] = tip
            elif len(below) == 1:
                r[i] = max(tip, tip + (anchor - tip) * s[i] / reach)
            else:
                r[i] = max(tip, anchor * s[i] / share if share > 0 else tip)
            quality[i] = ALLOMETRIC
        todo += [(ident[i], r[i], s[i]) for i in below]
    t["radius"], t["quality"] = r, quality
    return t


def pipe_model(cylinders: DataFrame, tip: float = 0.0025) -> DataFrame:
    """Unset radii from the nearest set one below: a linear taper to the tip along a run, shares by squared subtree
    length at a fork, the tip where nothing below is set; such radii get the allometric quality."""
    return _per_tree(cylinders, lambda t: piped(t, tip))


#: How much of the trunk gives the direction (metres, share), the steepest tilt, growth of radii a segment.
TRUNK_METRES, TRUNK_SHARE, TILT, GROWTH = 3.0, 0.25, 50.0, 1.01


def prolongate(cylinders: DataFrame, lengths: DataFrame, step: float = 0.1) -> DataFrame:
    """Cylinders numbered -n..-1 from the ground to the root, for the (tree_id, prolong) metres missing there.

    They follow the trunk's direction over its first 3 m or quarter, tilted by 50 degrees at most, and thicken by 1 % each.
    Trees with fewer than two trunk cylinders, or nothing missing, stay as they are.  Column expressions only: a running
    length per trunk, one row a tree with its direction, a sequence of segments.
    """
    from boscage.functions.geometry import length

    down = Window.partitionBy("tree_id").orderBy(F.desc("subtree_length"), "cyl_ID")
    every = Window.partitionBy("tree_id")
    trunk = cylinders.where("axis_ID = 1").withColumns({"_n": F.count("*").over(every), "_i": F.row_number().over(down), "_run": F.sum(length()).over(down.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(length()).over(every)}).where("_n > 1")
    near = F.least(F.lit(TRUNK_METRES), F.col("_all") * TRUNK_SHARE)
    head = lambda c: F.min_by(c, "_i")
    reach = F.max_by(F.struct(*[f"end{a}" for a in "XYZ"]), F.when((F.col("_run") <= near) | (F.col("_i") == 1), F.col("_i")))
    one = trunk.groupBy("tree_id").agg(*[head(c).alias(f"_{c}") for c in ("cyl_ID", "startX", "startY", "startZ", "subtree_length", "radius")], reach.alias("_to"), F.max("_all").alias("_all"))
    one = one.join(lengths.select("tree_id", "prolong"), "tree_id").where("prolong > 0 and _all > 0")
    way = [F.col(f"_to.end{a}") - F.col(f"_start{a}") for a in "XYZ"]
    one = one.withColumn("_size", F.sqrt(way[0] ** 2 + way[1] ** 2 + way[2] ** 2)).where("_size > 0").withColumns({f"_w{a}": w / F.col("_size") for a, w in zip("XYZ", way, strict=True)})
    steep = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_wZ"))))) > TILT
    flat = F.hypot("_wX", "_wY")
    across = [F.when(flat > 0, F.col(f"_w{a}") / flat).otherwise(0.0) * math.sin(math.radians(TILT)) for a in "XY"]
    one = one.withColumns({**{f"_v{a}": F.when(steep, x).otherwise(F.col(f"_w{a}")) for a, x in zip("XY", across, strict=True)}, "_vZ": F.when(steep, math.cos(math.radians(TILT))).otherwise(F.col("_wZ"))})
    one = one.withColumn("_far", F.col("prolong") / F.col("_vZ")).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_far") / step)).cast("long")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    kinds = dict(cylinders.dtypes)
    made = {"tree_id": F.col("tree_id"), "cyl_ID": -F.col("i"), "parent_ID": -F.col("i") - 1, "subtree_length": F.col("_subtree_length") + F.col("_far") / F.col("_n") * F.col("i"), "radius": F.col("_radius") * F.pow(F.lit(GROWTH), F.col("i") - 1.0)}
    for e, back in (("start", 0), ("end", 1)):
        made |= {f"{e}{a}": F.col(f"_start{a}") - F.col(f"_v{a}") * (F.col("_far") * (F.col("i") - back) / F.col("_n")) for a in "XYZ"}
    made |= {c: F.lit(v) for c, v in (("axis_ID", 1), ("branch_order", 1), ("quality", PROLONGED)) if c in kinds}
    new = one.select(*[made[c].cast(kinds[c]).alias(c) for c in cylinders.columns if c in made])
    hung = one.where("i = 1").select("tree_id", F.col("_cyl_ID").alias("cyl_ID"), F.lit(True).alias("_hung"))
    old = cylinders.join(hung, ["tree_id", "cyl_ID"], "left").withColumn("parent_ID", F.when(F.col("_hung"), F.lit(-1).cast(kinds["parent_ID"])).otherwise(F.col("parent_ID"))).select(*cylinders.columns)
    return old.unionByName(new, allowMissingColumns=True)


def layer_centres(points: DataFrame) -> DataFrame:
    """(tree_id, layer, cluster, X, Y, Z): mean place of each cluster of a tree's layer."""
    return points.groupBy(F.col("treeID").alias("tree_id"), "layer", "cluster").agg(*[F.avg(a).alias(a) for a in "XYZ"])


def chained(x: np.ndarray, layer: np.ndarray, max_d: float) -> list[tuple[int, int]]:
    """(from, to) of the chains through centres sorted by layer, as skeleton() tells."""
    used, links = np.zeros(len(x), bool), []
    now = int(x[:, 2].argmin())
    used[now] = True
    while not used.all():
        d2 = ((x - x[now]) ** 2).sum(1)
        open_ = np.flatnonzero(~used & (layer > layer[now]) & (d2 < max_d * max_d))
        if len(open_):
            to = int(open_[d2[open_].argmin()])
        else:
            to = int(np.flatnonzero(~used)[0])
            done = np.flatnonzero(used)
            now = int(done[((x[done] - x[to]) ** 2).sum(1).argmin()])
        links.append((now, to))
        used[to], now = True, to
    return links


def skeleton(centres: DataFrame, max_d: float = 0.1) -> DataFrame:
    """(tree_id, cyl_ID, parent_ID, start, end) that chain the (tree_id, layer, cluster, X, Y, Z) of each tree.

    From the lowest centre a chain goes to the nearest free centre of a higher layer nearer than max_d.  Where there is
    none, the free centre of the least layer hangs on its nearest used one and starts the next chain.  Ties go to the
    smaller (layer, cluster).  A tree of one centre has no cylinder.
    """
    schema = "tree_id long, cyl_ID long, parent_ID long, startX double, startY double, startZ double, endX double, endY double, endZ double"

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["layer", "cluster"]).reset_index(drop=True)
        x = t[["X", "Y", "Z"]].to_numpy(float)
        links = chained(x, t["layer"].to_numpy(), max_d)
        own = {to: i + 1 for i, (_, to) in enumerate(links)}
        rows = [(t["tree_id"].iloc[0], i + 1, own.get(a, 0), *x[a], *x[to]) for i, (a, to) in enumerate(links)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return centres.select("tree_id", "layer", "cluster", "X", "Y", "Z").groupBy("tree_id").applyInPandas(run, schema)
