"""Models of trees from their points, whole trees in a task.

A tree's points are bounded by nature; the forest is one shuffle by treeID.  Within a task everything is numpy: neighbours
block by block, paths by relaxing whole frontiers, clusters by voxels, fits by the vectorised cross-sections of
operators.fitting.  A failure is a row with its message, not the end of the job.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.functions.geometry import GRIESE_A, GRIESE_B, GRIESE_C, GRIESE_LINEAR, PRESETS
from boscage.operators.fitting import Fit, fit
from boscage.operators.folds import by_tree, fold
from boscage.operators.points import eligible_trees
from boscage.operators.skeleton import chained, piped, places_smoothed, radii_smoothed
from boscage.operators.trees import CONIC, MEASURED, POLYNOMIAL, REFINED, UNKNOWN
from boscage.params import Qsm

#: Neighbours, widest gap and power of the paths within a tree; points and radius from which a cylinder is measured.
K, GAP, POWER, LEAST_POINTS, BUTTRESS = 80, 1.5, 1.5, 50, 0.15
SCHEMA = "tree_id long, startX double, startY double, startZ double, endX double, endY double, endZ double, cyl_ID long, parent_ID long, axis_ID long, branch_order int, dist_to_root double, subtree_length double, radius double, quality int, message string"


def neighbours(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the k nearest others of each point, block by block of points that lie close together."""
    n = len(x)
    k = min(k, n - 1)
    if k <= 0:
        return np.zeros((n, 0), np.int64), np.zeros((n, 0))
    cell = np.floor(x / 0.3)
    order = np.lexsort((cell[:, 0], cell[:, 1], cell[:, 2]))
    rows, far = np.zeros((n, k), np.int64), np.zeros((n, k))
    for s in range(0, n, 128):
        own = order[s : s + 128]
        r, lo, hi = 0.25, x[own].min(0), x[own].max(0)
        while True:
            near = np.flatnonzero(((x >= lo - r) & (x <= hi + r)).all(1))
            if len(near) > k:
                d2 = (x[own] ** 2).sum(1)[:, None] + (x[near] ** 2).sum(1)[None] - 2 * x[own] @ x[near].T
                d2[near[None] == own[:, None]] = np.inf
                pick = np.argpartition(d2, k - 1, 1)[:, :k]
                found = np.take_along_axis(d2, pick, 1)
                if len(near) == n or found.max() <= r * r:
                    break
            r *= 2
        rows[own], far[own] = near[pick], np.sqrt(np.maximum(found, 0))
    return rows, far


def voxel_labels(x: np.ndarray, size: float) -> np.ndarray:
    """Components of touching voxels (26 neighbours), numbered from 0."""
    if len(x) == 1:
        return np.zeros(1, np.int64)
    cell = np.floor((x - x.min(0)) / size).astype(np.int64) + 1
    wide = cell.max(0) + 2
    key = (cell[:, 0] * wide[1] + cell[:, 1]) * wide[2] + cell[:, 2]
    cells, back = np.unique(key, return_inverse=True)
    steps = [(a * wide[1] + b) * wide[2] + c for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
    at = [np.minimum(np.searchsorted(cells, cells + s), len(cells) - 1) for s in steps]
    pairs = np.concatenate([np.stack([np.flatnonzero(cells[j] == cells + s), j[cells[j] == cells + s]]) for s, j in zip(steps, at, strict=True)], 1)
    return np.unique(_joined(len(cells), *pairs), return_inverse=True)[1][back]


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new[new]]
        if (new == label).all():
            return label
        label = new


def lengths_to_root(x: np.ndarray, seeds: np.ndarray, k: int = K, gap: float = GAP, power: float = POWER) -> np.ndarray:
    """G10 within a tree: length of the cheapest path from the seeds; clusters out of reach are bridged where they come nearest."""
    rows, far = neighbours(x, k)
    near = far <= gap
    cost = np.where(near, far**power, np.inf)
    best, way, todo = np.full(len(x), np.inf), np.full(len(x), np.inf), np.flatnonzero(seeds)
    best[todo], way[todo] = 0.0, 0.0
    while True:
        while len(todo):
            a, b = np.repeat(todo, rows.shape[1]), rows[todo].ravel()
            c, w = (best[todo][:, None] + cost[todo]).ravel(), (way[todo][:, None] + far[todo]).ravel()
            better = np.flatnonzero(c < best[b] - 1e-12)
            order = better[np.lexsort((a[better], c[better], b[better]))]
            first = order[np.flatnonzero(np.append(True, np.diff(b[order]) != 0))] if len(order) else order
            best[b[first]], way[b[first]] = c[first], w[first]
            todo = b[first]
        lost = np.isinf(best)
        if not lost.any() or lost.all():
            return np.where(lost, -1.0, way)
        out, held = np.flatnonzero(lost), np.flatnonzero(~lost)
        gapped = np.full(len(out), np.inf)
        to = np.zeros(len(out), np.int64)
        for s in range(0, len(out), 256):
            d = ((x[out[s : s + 256], None] - x[held][None]) ** 2).sum(2)
            to[s : s + 256], gapped[s : s + 256] = held[d.argmin(1)], np.sqrt(d.min(1))
        i = int(gapped.argmin())  # the nearest of all; what it belongs to is relaxed from there
        best[out[i]], way[out[i]] = best[to[i]] + gapped[i] ** power, way[to[i]] + gapped[i]
        todo = out[i : i + 1]


def expected_dbh(h: float, name: str) -> float:
    """P19 as a number: breast-height diameter in metres from height."""
    if name in ("Griese2025", "Cacao"):
        inverse = lambda v: -math.log(1 - (v / GRIESE_A) ** (1 / GRIESE_C)) / GRIESE_B
        at = inverse(GRIESE_LINEAR)
        fall = math.exp(-GRIESE_B * at)
        slope = 1 / (GRIESE_A * GRIESE_C * (1 - fall) ** (GRIESE_C - 1) * GRIESE_B * fall)
        return (inverse(max(h, 0.0)) if h < GRIESE_LINEAR else at + slope * (h - GRIESE_LINEAR)) / 100 * (3 if name == "Cacao" else 1)
    from boscage.functions.geometry import CHENGE, COSTA

    if name == "CostaCysneiros2020":
        return math.exp((math.log(max(h, 1e-9)) - COSTA[0]) / COSTA[1]) / 100
    if name == "Chenge2020":
        return (h / CHENGE[0]) ** (1 / CHENGE[1]) / 100
    raise ValueError(f"unknown allometry {name}")


def accepted(f: Fit, preset: str, known: float = math.nan, least: float | None = None) -> bool:
    """P22 for one fit."""
    r, arc, inlier, shrink = PRESETS[preset]
    good = f.success and f.radius >= (r if least is None else least) and f.arc_deg > arc and f.inlier_pct > inlier
    return good and not (shrink < 1 and known > 0 and (f.radius - known) / known < -shrink)


def architecture(t: pd.DataFrame, by_volume: bool = False) -> pd.DataFrame:
    """G13 to G17 of one tree: folds, axes numbered from 1 with the trunk first."""
    column = {c: t[c].to_numpy() for c in ("cyl_ID", "parent_ID", "endZ", "radius")}
    length = np.linalg.norm(_places(t, "end") - _places(t, "start"), axis=1)
    f = fold(column["cyl_ID"], column["parent_ID"], length, column["endZ"], column["radius"], by_volume)
    heads, number = np.unique(f["axis"], return_inverse=True)
    own = np.flatnonzero(np.isin(column["cyl_ID"], heads))
    own = own[np.lexsort((column["cyl_ID"][own], -f["subtree_length"][own], f["branch_order"][own]))]
    place = np.empty(len(heads), np.int64)
    place[np.searchsorted(heads, column["cyl_ID"][own])] = np.arange(1, len(own) + 1)
    new = {"axis_ID": place[number], "branch_order": f["branch_order"], "dist_to_root": f["dist_to_root"], "subtree_length": f["subtree_length"], "length": length}
    return _with(t, **new)


def _places(t: pd.DataFrame, end: str) -> np.ndarray:
    return np.stack([t[f"{end}{a}"].to_numpy() for a in "XYZ"], 1)


def _with(t: pd.DataFrame, **columns: np.ndarray) -> pd.DataFrame:
    """t.assign(), which for a tree's few rows takes longer than what it holds."""
    return pd.DataFrame({**{c: t[c].to_numpy() for c in t.columns}, **columns}, t.index, copy=False)


def conic(t: pd.DataFrame, r0: float, tip: float) -> np.ndarray:
    """R8 for one tree."""
    w, w0 = t["subtree_length"].to_numpy(), t["subtree_length"].max()
    return np.full(1, r0) if len(t) == 1 else np.full(len(t), tip) if w0 == 0 else tip + (w / w0) ** 1.1 * (r0 - tip)


def _sections(t: pd.DataFrame, x: np.ndarray, edge: np.ndarray):
    """(row, its points, start, end) of the cylinders that have points."""
    order = np.argsort(edge, kind="stable")
    ids, at, n = np.unique(edge[order], return_index=True, return_counts=True)
    where = {c: i for i, c in enumerate(t["cyl_ID"])}
    for c, a, k in zip(ids.tolist(), at.tolist(), n.tolist(), strict=True):
        if c in where:
            yield where[c], x[order[a : a + k]]


def measured(t: pd.DataFrame, x: np.ndarray, edge: np.ndarray, guess: np.ndarray, q: Qsm) -> pd.DataFrame:
    """R2: radii of cylinders with enough points whose expected radius can be measured; others are unset."""
    radius, quality = np.full(len(t), np.nan), np.full(len(t), UNKNOWN)
    start, end = _places(t, "start"), _places(t, "end")
    for i, own in _sections(t, x, edge):
        if len(own) >= LEAST_POINTS and guess[i] >= q.min_measurable_radius and (start[i] != end[i]).any():
            f = fit(own, 0.04, "buttress" if guess[i] > BUTTRESS else "standard", start[i], end[i])
            if accepted(f, "standard", least=q.min_measurable_radius):
                radius[i], quality[i] = f.radius, REFINED if accepted(f, "accurate") else MEASURED
    return _with(t, radius=radius, quality=quality)


def refined(t: pd.DataFrame, x: np.ndarray, edge: np.ndarray) -> pd.DataFrame:
    """R3 for broken trees, W11: axes are measured again from base to tip until five cylinders in a row fail."""
    t = t.reset_index(drop=True)
    radius, quality = t["radius"].to_numpy(float).copy(), t["quality"].to_numpy().copy()
    start, end = _places(t, "start"), _places(t, "end")
    own = dict(_sections(t, x, edge))
    for _, g in t.sort_values(["axis_ID", "subtree_length", "cyl_ID"], ascending=[True, False, True]).groupby("axis_ID"):
        failed = 0
        for i in g.index:
            if failed >= 5:
                break
            f = fit(own[i], 0.04, "standard", start[i], end[i]) if i in own and (start[i] != end[i]).any() else Fit()
            if accepted(f, "accurate_large", radius[i]):
                radius[i], quality[i] = f.radius, REFINED
            failed = failed + 1 if quality[i] < MEASURED else 0
    return _with(t, radius=radius, quality=quality)


def _taper(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """R6 for one axis: (a, b) of a x + b x^2 with its slope vanishing at the largest x."""
    xm = x.max()
    z = x * x - 2 * xm * x
    if (z * z).sum() >= 1e-12:
        b = float((z * y).sum() / (z * z).sum())
        return -2 * b * xm, b
    m = np.c_[x, x * x]
    det = np.linalg.det(m.T @ m)
    return (0.0, 0.0) if abs(det) < 1e-12 else tuple(np.linalg.solve(m.T @ m, m.T @ y))


def tapered(t: pd.DataFrame, tip: float) -> pd.DataFrame:
    """R4 and R5 for one tree."""
    t = t.reset_index(drop=True)
    r, quality, s, d = t["radius"].to_numpy(float).copy(), t["quality"].to_numpy().copy(), t["subtree_length"].to_numpy(), t["dist_to_root"].to_numpy()
    for axis, g in t.groupby("axis_ID").groups.items():
        g = np.asarray(g)
        for low in (False, True) if axis == 1 else (False,):
            m = g[~np.isnan(r[g]) & ((d[g] <= 1.3) if low else (d[g] > 1.3))]
            if len(m) <= (4 if low else 6):
                if not low:
                    r[g], quality[g] = np.nan, UNKNOWN
                continue
            a, b = _taper(s[m], r[m] - (0 if low else tip))
            guess = a * s[g] + b * s[g] ** 2 + (0 if low else tip)
            off = (np.abs(r[g] - guess) > 0.3 * guess) & (quality[g] < REFINED) & ((d[g] <= 1.3) if low else True)
            new = g[(s[g] >= s[m].min()) & (np.isnan(r[g]) | off)]
            r[new], quality[new] = a * s[new] + b * s[new] ** 2 + (0 if low else tip), POLYNOMIAL
    return _with(t, radius=r, quality=quality)


def without_weird_butt(t: pd.DataFrame) -> pd.DataFrame:
    """The trunk before its first four cylinders in a row that tilt less than 50 degrees goes, with what hangs there."""
    trunk = t[t["axis_ID"] == 1].sort_values(["dist_to_root", "cyl_ID"])
    if len(trunk) < 5:
        return t
    v = _places(trunk, "end") - _places(trunk, "start")
    n = np.linalg.norm(v, axis=1)
    fine = np.degrees(np.arccos(np.clip(v[:, 2] / np.maximum(n, 1e-12), -1, 1))) < 50
    run = [i for i in range(len(fine) - 3) if fine[i : i + 4].all()]
    if not run or run[0] == 0:
        return t
    head = int(trunk["cyl_ID"].iloc[run[0]])
    children: dict[int, list[int]] = {}
    for child, parent in zip(t["cyl_ID"].tolist(), t["parent_ID"].tolist(), strict=True):
        children.setdefault(parent, []).append(child)
    kept, todo = set(), [head]
    while todo:
        now = todo.pop()
        kept.add(now)
        todo += children.get(now, [])
    t = t[t["cyl_ID"].isin(kept)].reset_index(drop=True)
    t.loc[t["cyl_ID"] == head, "parent_ID"] = 0
    return architecture(t)


def _skeleton(x: np.ndarray, way: np.ndarray, q: Qsm, step: float) -> tuple[pd.DataFrame, np.ndarray, int]:
    """(cylinders, cylinder of each point, clean large sections): layers along the way, clusters, centres, chains."""
    layer = np.floor((way - math.floor(way.min()) + 1e-9) / step).astype(int)
    group = np.zeros(len(x), np.int64)
    for at in np.split(np.argsort(layer, kind="stable"), np.flatnonzero(np.diff(np.sort(layer))) + 1):
        group[at] = voxel_labels(x[at], q.dbscan_eps)
    key, back = np.unique(np.stack([layer, group], 1), axis=0, return_inverse=True)
    back = back.ravel()
    n = np.bincount(back)
    centre = np.stack([np.bincount(back, x[:, i]) / n for i in range(3)], 1)
    clean = 0
    for i in np.flatnonzero(n >= 100):  # A29: large clusters take their fitted centre
        f = fit(x[back == i], 0.04, "basic")
        if accepted(f, "accurate_large"):
            clean += 1
        if accepted(f, "standard"):
            centre[i, :2] = f.center[:2]
    links = chained(centre, key[:, 0], q.max_d)
    own = {to: i + 1 for i, (_, to) in enumerate(links)}
    rows = [(i + 1, own.get(a, 0), *centre[a], *centre[b]) for i, (a, b) in enumerate(links)]
    t = pd.DataFrame(rows, columns=["cyl_ID", "parent_ID", "startX", "startY", "startZ", "endX", "endY", "endZ"])
    edge = np.array([own.get(i, 0) for i in range(len(key))])[back]
    return t.assign(radius=np.nan, quality=UNKNOWN), edge, clean


def _fix_roots(t: pd.DataFrame) -> pd.DataFrame:
    """Several cylinders from one root hang on one more, a centimetre below."""
    roots = t["parent_ID"] == 0
    if roots.sum() < 2:
        return t
    s = t[roots].iloc[0]
    new = int(t["cyl_ID"].max()) + 1
    t.loc[roots, "parent_ID"] = new
    first = {**s.to_dict(), "cyl_ID": new, "parent_ID": 0, "startZ": s["startZ"] - 0.01, "endX": s["startX"], "endY": s["startY"], "endZ": s["startZ"]}
    return pd.concat([t, pd.DataFrame([first])], ignore_index=True)


def construct_radii(t: pd.DataFrame, x: np.ndarray, hag: np.ndarray, edge: np.ndarray, q: Qsm, clean: int, notes: list[str]) -> tuple[pd.DataFrame, bool, bool]:
    """(cylinders with radii, whether anything was measured, whether the tree is likely broken)."""
    h = max(float(t["dist_to_root"].max()), float(hag.max(initial=0.0)))
    d0 = expected_dbh(h, q.allometry_name) * q.allometry_scale
    r0, tip, broken = d0 / 2, q.apex_radius, clean > 5
    if d0 < q.min_measurable_dbh and not broken:
        notes.append(f"[Small tree allometry] H = {h:.2f} m, expected DBH = {d0 * 100:.1f} cm: radii are allometric")
        return t.assign(radius=conic(t, r0, tip), quality=CONIC), True, False
    broken = broken and d0 < q.min_measurable_dbh
    if broken:
        notes.append(f"[Broken tree] H = {h:.2f} m, expected DBH = {d0 * 100:.1f} cm, but it has clean sections")
    t = architecture(measured(t, x, edge, conic(t, 1.5 * r0, tip), q), True)
    t = tapered(t, tip)
    if t.loc[t["axis_ID"] == 1, "radius"].isna().all():
        return t.assign(radius=conic(t, r0, tip), quality=CONIC), False, broken
    t = piped(t, tip)
    root = float(t.loc[(t["axis_ID"] == 1) & (t["parent_ID"] == 0), "radius"].max())
    if root > 3 * r0 and not broken:
        notes.append(f"[Diameter anomaly] the root's diameter is {2 * root:.2f} m, {2 * r0:.2f} m are expected")
    return t, True, broken


def _prolonged(t: pd.DataFrame, missing: float, step: float = 0.1) -> pd.DataFrame:
    """R11 for one tree; numbers of the new cylinders are above the others'."""
    from boscage.operators.skeleton import GROWTH, PROLONGED, TILT, TRUNK_METRES, TRUNK_SHARE

    trunk = t[t["axis_ID"] == 1].sort_values(["subtree_length", "cyl_ID"], ascending=[False, True])
    if not missing > 0 or len(trunk) < 2:
        return t
    a, b = _places(trunk, "start"), _places(trunk, "end")
    run = np.cumsum(np.linalg.norm(b - a, axis=1))
    way = b[max(0, int((run <= min(TRUNK_METRES, TRUNK_SHARE * run[-1])).sum()) - 1)] - a[0]
    if not np.linalg.norm(way):
        return t
    way = way / np.linalg.norm(way)
    if math.degrees(math.acos(max(-1.0, min(1.0, way[2])))) > TILT:
        flat = math.hypot(*way[:2])
        way = np.array([*(way[:2] / flat * math.sin(math.radians(TILT)) if flat else (0, 0)), math.cos(math.radians(TILT))])
    far = missing / way[2]
    n = max(1, math.ceil(far / step))
    root, last = trunk.iloc[0], int(t["cyl_ID"].max())
    new = [{**root.to_dict(), "cyl_ID": last + i, "parent_ID": 0 if i == n else last + i + 1, **{f"{e}{c}": a[0][j] - way[j] * far * (i - k) / n for e, k in (("start", 0), ("end", 1)) for j, c in enumerate("XYZ")}, "radius": root["radius"] * GROWTH ** (i - 1), "quality": PROLONGED} for i in range(1, n + 1)]
    t.loc[t["cyl_ID"] == root["cyl_ID"], "parent_ID"] = last + 1
    return pd.concat([t, pd.DataFrame(new)], ignore_index=True)


def build(x: np.ndarray, hag: np.ndarray, foliage: np.ndarray, q: Qsm = Qsm()) -> tuple[pd.DataFrame, list[str]]:
    """V6: the cylinders of one tree's points, and messages.  A tree without wood or with one node has no cylinder."""
    notes: list[str] = []
    none = pd.DataFrame(columns=["cyl_ID", "parent_ID"])
    if not len(x):
        raise ValueError("empty point cloud")
    z = x[:, 2]
    wood = (foliage == 0) & (z >= z.min() + 0.01 * (z.max() - z.min()))
    if not wood.any():
        return none, ["[No wood point] This tree has no point labelled as wood"]
    wood[int(z.argmax())] = True
    x, hag = x[wood], hag[wood]
    away = x[int(x[:, 2].argmin())].copy()
    x = x - away
    butt = np.flatnonzero(x[:, 2] <= 0.25)  # C7
    label = voxel_labels(x[butt], 0.05)
    stay = np.ones(len(x), bool)
    stay[butt[label != np.bincount(label).argmax()]] = False
    x, hag = x[stay], hag[stay]
    way = lengths_to_root(x, x[:, 2] < 0.05 * (math.floor(x[:, 2].min() / 0.05) + 1))
    held = way >= 0
    x, hag, way = x[held], hag[held], way[held]
    for step in (q.skeleton_node_distance, 2 * q.skeleton_node_distance):
        t, edge, clean = _skeleton(x, way, q, step)
        if not len(t):
            return none, notes
        t = without_weird_butt(places_smoothed(architecture(_fix_roots(t)), q.smooth_steps))
        t, good, broken = construct_radii(t, x, hag, edge, q, clean, notes)
        if good:
            break
        notes.append("[No valid measure] Not a single valid measure for this tree")
    t = places_smoothed(architecture(t, True), q.smooth_steps // 2)
    if broken and q.broken_detection:
        t = places_smoothed(architecture(refined(t, x, edge), True), q.smooth_steps // 2)
    below = hag[x[:, 2] <= t["startZ"].min()]  # R10
    t = _prolonged(t, float(below.max()) if len(below) else 0.0)
    t = architecture(radii_smoothed(architecture(t, True)), True)
    t = _with(t, **{f"{e}{a}": t[f"{e}{a}"].to_numpy() + away[i] for e in ("start", "end") for i, a in enumerate("XYZ")})
    if t["radius"].isna().any() or (t["parent_ID"] == 0).sum() != 1:
        raise ValueError("the model is no single tree with all radii set")
    return t, notes


def qsm_of(points: DataFrame, q: Qsm = Qsm()) -> DataFrame:
    """A model for each treeID of (treeID, X, Y, Z, hag, foliage).

    Each tree has one row at least: messages stand in its first row (`message`), and a tree that failed or has no cylinder
    has a row without cyl_ID.
    """
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def of_tree(tree: int | None, t: np.ndarray, hag: np.ndarray, foliage: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((t[:, 1], t[:, 0], t[:, 2]))
        try:
            t, notes = build(t[order], hag[order], foliage[order], q)
        except Exception as e:  # noqa: BLE001  a tree that fails is reported as a row
            t, notes = pd.DataFrame(columns=["cyl_ID"]), [f"[Failed] {type(e).__name__}: {e}"]
        if not len(t):
            t = pd.DataFrame([{"cyl_ID": None}])
        t = t.sort_values("cyl_ID")
        return _with(t, tree_id=np.full(len(t), tree, object), message=np.array(["; ".join(notes) or None] + [None] * (len(t) - 1), object))

    def run(table: pa.Table, tree: np.ndarray) -> pa.Table:
        x = np.stack([np.asarray(table[a].cast(pa.float64()).fill_null(np.nan)) for a in "XYZ"], 1)
        hag, foliage = np.asarray(table["hag"].cast(pa.float64()).fill_null(np.nan)), np.asarray(table["foliage"].cast(pa.float64()).fill_null(np.nan))
        first = np.flatnonzero(np.append(True, np.diff(tree) != 0))
        ids = table["treeID"].take(pa.array(first)).to_pylist()
        made = [of_tree(k, x[a:b], hag[a:b], foliage[a:b]) for k, a, b in zip(ids, first, np.append(first[1:], len(tree)), strict=True)]
        held = {c: np.concatenate([m[c].to_numpy(object) if c in m else np.full(len(m), None) for m in made]) for c in columns}
        kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
        return pa.table({c: pa.array([int(v) if v is not None and v == v else None for v in held[c]] if k in ("long", "int") else held[c], kinds[k], from_pandas=True) for c, k in (f.split() for f in SCHEMA.split(", "))})

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return by_tree(points.select(F.col("treeID").cast("long").alias("treeID"), "X", "Y", "Z", "hag", "foliage"), run, SCHEMA, "treeID", tasks)


def qsf(points: DataFrame, min_height: float = 2, q: Qsm = Qsm()) -> DataFrame:
    """V7, F16: models of all eligible trees; those of one node or none have no row unless they have a message."""
    return qsm_of(eligible_trees(points, min_height), q).where("cyl_ID is not null or message is not null")
