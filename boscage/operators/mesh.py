"""Meshes of tree models: one tube an axis, with a ring of vertices around each node.

A ring's frame depends on the one before it, so rings are built in numpy over batches of whole trees, a step for all axes at
once; vertices and faces are column expressions over the rings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.operators.folds import by_tree, parents

#: The least radius of a ring, and how near to parallel two directions may be and still share a frame.
LEAST_RADIUS, PARALLEL = 1e-9, 1e-6

RINGS = "tree_id long, axis_ID long, place long, cyl_ID long, ring long, next long, x double, y double, z double, r double, ux double, uy double, uz double, vx double, vy double, vz double"


def frame(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """M3: two unit vectors across each d; the first is level, along x where d is vertical."""
    flat = np.hypot(d[..., 0], d[..., 1])[..., None]
    level = np.concatenate([-d[..., 1:2], d[..., :1], np.zeros_like(flat)], -1) / np.where(flat > PARALLEL, flat, 1.0)
    u = np.where(flat > PARALLEL, level, np.array([1.0, 0.0, 0.0]))
    return u, np.cross(d, u)


def transported(u: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """M3: the frames (u, v) of directions a for directions b, turned without a twist; where b is opposite, v changes its sign."""
    dot = lambda p, q: (p * q).sum(-1, keepdims=True)
    cos = dot(a, b)
    same, opposite = cos > 1 - PARALLEL, cos < PARALLEL - 1
    w = u - dot(u, b) / np.where(opposite, 1.0, 1 + cos) * (a + b)
    w = w - dot(w, b) * b
    size = np.linalg.norm(w, axis=-1, keepdims=True)
    w = w / np.where(same | opposite, 1.0, size)
    return np.where(same | opposite, u, w), np.where(same, v, np.where(opposite, -v, np.cross(b, w)))


def _unit(d: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(d, axis=1, keepdims=True)
    return d / np.where(n > 1e-12, n, 1.0)


def _walks(axis: np.ndarray, ident: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places): the cylinders of each axis from its base on; of several children the smallest number, of several bases too.

    Axes are numbered from 0; rows are sorted by axis and cyl_ID.  All axes go on by one cylinder a step.
    """
    up = parents(ident, parent, axis)
    low = np.append(0, np.flatnonzero(np.diff(axis)) + 1) if len(axis) else np.zeros(0, int)
    # the base: the least parent that is no cylinder of the axis; on a cycle the least cylinder; then its first child
    first = np.minimum.reduceat(np.where(up < 0, parent, NONE), low) if len(low) else low
    first = np.where(np.logical_or.reduceat(up < 0, low) if len(low) else low > 0, first, ident[low])
    order = np.lexsort((np.arange(len(axis)), parent, axis))  # rows by parent: the first of each is the child to follow
    head = order[np.append(True, (np.diff(axis[order]) != 0) | (np.diff(parent[order]) != 0))[: len(order)]]
    child = np.full(len(axis), -1)
    has = up[head] >= 0
    child[up[head[has]]] = head[has]
    child = child[parents(ident, ident, axis)]  # cylinders of the same number share their child
    now = head[parent[head] == first[axis[head]]]
    rows, places, seen, place = [], [], np.zeros(len(axis), bool), 0
    while len(now):
        seen[now] = True
        rows.append(now)
        places.append(np.full(len(now), place))
        now, place = child[now], place + 1
        now = now[now >= 0]
        now = now[~seen[now]]
    if not rows:
        return np.zeros(0, int), np.zeros(0, int)
    row, at = np.concatenate(rows), np.concatenate(places)
    order = np.lexsort((at, axis[row]))
    return row[order], at[order]


def _rings(tree: np.ndarray, axis_ID: np.ndarray, ident: np.ndarray, parent: np.ndarray, start: np.ndarray, end: np.ndarray, radius: np.ndarray) -> dict[str, np.ndarray]:
    """The rings of whole trees, as rings_of() tells, with the number of the tree; all axes are turned along step by step."""
    order = np.lexsort((ident, axis_ID, tree))
    tree, axis_ID, ident, parent, start, end, radius = (x[order] for x in (tree, axis_ID, ident, parent, start, end, radius))
    axis = np.cumsum(np.append(True, (np.diff(tree) != 0) | (np.diff(axis_ID) != 0))[: len(tree)]) - 1
    row, place = _walks(axis, ident, parent)
    base = place == 0
    # a node more than cylinders: the base's start, then every end
    n = len(row) + int(base.sum())
    node = np.arange(len(row)) + np.cumsum(base)  # of each cylinder's end
    foot = node[base] - 1
    at, own, step = np.empty((n, 3)), np.empty(n, int), np.zeros(n, int)
    at[foot], at[node] = start[row[base]], end[row]
    own[foot], own[node] = row[base], row
    step[node] = place + 1
    last = np.append(step[1:] == 0, True)[:n]
    along, r = np.zeros((n, 3)), np.zeros(n)  # of the cylinder that ends at a node
    along[node], r[node] = _unit(at[node] - at[node - 1]), radius[row]
    here = np.flatnonzero(~last)
    d, mean = along.copy(), r.copy()
    inner = here[step[here] > 0]
    d[inner], mean[inner] = _unit(along[inner] + along[inner + 1]), (r[inner] + r[inner + 1]) / 2
    d[foot], mean[foot] = along[foot + 1], r[foot + 1]
    u, v = np.empty((n, 3)), np.empty((n, 3))
    u[foot], v[foot] = frame(d[foot])
    now = foot
    while len(now):
        now = now[~last[now]] + 1
        u[now], v[now] = transported(u[now - 1], v[now - 1], d[now - 1], d[now])
    kept = mean > LEAST_RADIUS  # false for unset ones
    trees = tree[own]
    count = np.cumsum(kept) - 1
    first = np.append(True, np.diff(trees) != 0)[:n]
    ring = count - np.maximum.accumulate(np.where(first, count - kept + 1, 0)) if n else count
    follows = ~last & np.append(kept[1:], False)[:n]
    out = {"tree": trees, "axis_ID": axis_ID[own], "place": step, "cyl_ID": ident[own], "ring": ring, "next": np.where(follows, ring + 1, -1)}
    out |= {c: x for c, x in zip("xyz", at.T, strict=True)} | {"r": mean}
    out |= {f"{p}{c}": x for p, w in (("u", u), ("v", v)) for c, x in zip("xyz", w.T, strict=True)}
    return {c: x[kept] for c, x in out.items()}


#: The cylinders' columns that rings need; a parent that is null stands before all numbers, no base behind them.
NEED, NULL, NONE = ("cyl_ID", "parent_ID", "axis_ID", *(f"{e}{a}" for e in ("start", "end") for a in "XYZ"), "radius"), np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _rings_of_table(t: pa.Table, tree: np.ndarray) -> pa.Table:
    """The RINGS of a table of whole trees; cylinders without an axis have none."""
    known = np.asarray(t["axis_ID"].is_valid())
    t, tree = t.filter(pa.array(known)), tree[known]
    whole = lambda c: np.asarray(t[c].cast(pa.int64()).fill_null(NULL))
    number = lambda c: np.asarray(t[c].cast(pa.float64()).fill_null(np.nan))
    start, end = (np.stack([number(f"{e}{a}") for a in "XYZ"], 1) for e in ("start", "end"))
    got = _rings(tree, whole("axis_ID"), whole("cyl_ID"), whole("parent_ID"), start, end, number("radius"))
    first = np.flatnonzero(np.append(True, np.diff(tree) != 0)[: len(tree)])
    names = t["tree_id"].cast(pa.int64()).take(pa.array(first[np.searchsorted(tree[first], got.pop("tree"))], pa.int64()))
    after = got.pop("next")
    got = {"tree_id": names, **got, "next": pa.array(after, pa.int64(), mask=after < 0)}
    kinds = [c.split() for c in RINGS.split(", ")]
    return pa.table({c: got[c] if c in ("tree_id", "next") else pa.array(got[c]).cast(pa.int64() if kind == "long" else pa.float64()) for c, kind in kinds})


def rings_of(t: pd.DataFrame) -> pd.DataFrame:
    """M1: the rings of one tree.  Columns: axis_ID, place, cyl_ID, ring, next, centre, r and frame.

    A node's direction and radius are the means of the two cylinders at it.  A ring without radius is left out, and so are
    the faces to it; rings are numbered from 0 over axes in order, `next` is the ring that follows on the axis, if any.
    """
    one = pa.Table.from_pandas(t[list(NEED)].assign(tree_id=0), preserve_index=False)
    return _rings_of_table(one, np.zeros(len(t), int)).drop_columns(["tree_id"]).to_pandas()


def rings(cylinders: DataFrame) -> DataFrame:
    """M1: rings_of() each tree of a cylinder table with axis_ID and radius; no cylinders give no rings."""
    return by_tree(cylinders.select(F.col("tree_id").cast("long").alias("tree_id"), *NEED), _rings_of_table, RINGS)


def elements(ring: DataFrame, sides: int = 12, split: bool = True) -> DataFrame:
    """(tree_id, n, cyl_ID, x, y, z, centre, faces): `sides` vertices a ring, numbered from 0 within the tree, each
    with its ring's centre and with the two triangles (a, b, c), or the quad (a, b, c, d), that lie between it and the next ring."""
    t = ring.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    angle = F.col("side") * (2 * F.pi() / sides)
    at = [(F.col(a) + F.col("r") * (F.cos(angle) * F.col(f"u{a}") + F.sin(angle) * F.col(f"v{a}"))).alias(a) for a in "xyz"]
    here, then, far = F.col("ring") * sides, F.col("next") * sides, (F.col("side") + 1) % sides
    quad = [here + F.col("side"), here + far, then + far, then + F.col("side")]
    corners = ((0, 1, 2), (0, 2, 3)) if split else ((0, 1, 2, 3),)
    own = F.array(*[F.struct(*[quad[i].cast("long").alias(c) for i, c in zip(face, "abcd")]) for face in corners])
    return t.select("tree_id", (F.col("ring") * sides + F.col("side")).alias("n"), "cyl_ID", *at, F.struct("x", "y", "z").alias("centre"), F.when(F.col("next").isNotNull(), own).alias("faces"))


def vertices(ring: DataFrame, sides: int = 12) -> DataFrame:
    """(tree_id, n, cyl_ID, x, y, z): `sides` vertices a ring, numbered from 0 within the tree."""
    return elements(ring, sides).select("tree_id", "n", "cyl_ID", "x", "y", "z")


def faces(ring: DataFrame, sides: int = 12, split: bool = True) -> DataFrame:
    """M1, M2: (tree_id, a, b, c) of the triangles between rings that follow each other, or (.., d) of the quads."""
    return elements(ring, sides, split).select("tree_id", F.explode("faces").alias("f")).select("tree_id", "f.*")


def tree_mesh(t: pd.DataFrame, sides: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """M2: (vertices, triangles) of one tree, as vertices() and faces() number them; for writers of whole files."""
    ring = rings_of(t)
    turn = 2 * np.pi * np.arange(sides) / sides
    part = lambda names: ring[names].to_numpy(float)[:, None, :]
    v = part(["x", "y", "z"]) + ring["r"].to_numpy(float)[:, None, None] * (np.cos(turn)[:, None] * part(["ux", "uy", "uz"]) + np.sin(turn)[:, None] * part(["vx", "vy", "vz"]))
    follows = ring[ring["next"].notna()]
    side = np.arange(sides)
    here, then = (follows[c].to_numpy(np.int64)[:, None] * sides for c in ("ring", "next"))
    quad = np.stack([here + side, here + (side + 1) % sides, then + (side + 1) % sides, then + side], 2).reshape(-1, 4)
    return v.reshape(-1, 3), quad[:, [0, 1, 2, 0, 2, 3]].reshape(-1, 3)
