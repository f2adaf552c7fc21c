"""Cross-section fitting: circle, ellipse, Fourier and multi-circle fits, in numpy per group of points.

fit() works on one cross-section; fit_groups() runs it per key with applyInPandas, a group being one cross-section, which
physics bounds.  Random draws come from fixed seeds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boscage.functions.geometry import rotation_to_z

DRAWS = 1000


@dataclass
class Fit:
    success: bool = False
    shape_type: str = ""
    radius: float = 0.0
    center: tuple[float, float, float] = (0.0, 0.0, 0.0)
    inlier_pct: float = 0.0
    interior_pct: float = 0.0
    arc_deg: float = 0.0
    inliers: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    contour: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))


def arc_degrees(dx: np.ndarray, dy: np.ndarray) -> float:
    """Ten degrees for each bin of the longest circular run of occupied 10-degree bins."""
    if not len(dx):
        return 0.0
    hit = np.zeros(36, bool)
    hit[np.rint(np.degrees(np.arctan2(dy, dx)) / 10).astype(int) % 36] = True
    if hit.all():
        return 360.0
    best = now = 0
    for x in np.tile(hit, 2):
        now = now + 1 if x else 0
        best = max(best, now)
    return 10.0 * min(best, 36)


def arc_pairs(dx: np.ndarray, dy: np.ndarray) -> float:
    """Ten degrees for each pair of adjacent occupied bins, around the circle."""
    hit = np.zeros(36, bool)
    hit[np.rint(np.degrees(np.arctan2(dy, dx)) / 10).astype(int) % 36] = True
    return 10.0 * int((hit & np.roll(hit, 1)).sum())


def arc_coverage(points: DataFrame, key: str, dx: Column, dy: Column) -> DataFrame:
    """A31 as a query: (key, arc) by gaps and islands over the doubled circle of bins."""
    bins = points.select(key, F.pmod(F.rint(F.degrees(F.atan2(dy, dx)) / 10).cast("long"), F.lit(36)).alias("bin")).distinct()
    twice = bins.withColumn("o", F.explode(F.array(F.lit(0), F.lit(36)))).select(key, (F.col("bin") + F.col("o")).alias("bin"))
    island = F.col("bin") - F.row_number().over(Window.partitionBy(key).orderBy("bin"))
    runs = twice.withColumn("island", island).groupBy(key, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg((F.least(F.lit(36), F.max("n")) * 10).alias("arc"))


def _circles(p: np.ndarray, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and radii of circles through random triples."""
    rng = np.random.default_rng(seed)
    t = p[rng.integers(0, len(p), (draws, 3))]
    (ax, ay), (bx, by), (cx, cy) = (t[:, i].T for i in range(3))
    det = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    ok = np.abs(det) > 1e-12
    sq = (t**2).sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (sq[:, 0] * (by - cy) + sq[:, 1] * (cy - ay) + sq[:, 2] * (ay - by)) / det
        y = (sq[:, 0] * (cx - bx) + sq[:, 1] * (ax - cx) + sq[:, 2] * (bx - ax)) / det
    r = np.hypot(ax - x, ay - y)
    return x[ok], y[ok], r[ok]


def fit_circle(p: np.ndarray, tol: float, seed: int = 64) -> Fit:
    """The circle through three points that most points lie within `tol` of, then least squares on those."""
    if len(p) < 3:
        return Fit(shape_type="circle")
    x, y, r = _circles(p, DRAWS, seed)
    if not len(x):
        return Fit(shape_type="circle")
    off = np.abs(np.hypot(p[:, 0][None] - x[:, None], p[:, 1][None] - y[:, None]) - r[:, None])
    best = int((off < tol).sum(1).argmax())
    cx, cy, rr = x[best], y[best], r[best]
    for _ in range(2):
        near = np.abs(np.hypot(p[:, 0] - cx, p[:, 1] - cy) - rr) <= tol
        if near.sum() < 3:
            break
        q = p[near]
        a = np.c_[2 * q, np.ones(len(q))]
        s, *_ = np.linalg.lstsq(a, (q**2).sum(1), rcond=None)
        r2 = s[2] + s[0] ** 2 + s[1] ** 2
        if r2 <= 0:
            break
        new = np.abs(np.hypot(p[:, 0] - s[0], p[:, 1] - s[1]) - np.sqrt(r2)) <= tol
        if new.sum() < near.sum():
            break
        cx, cy, rr = s[0], s[1], float(np.sqrt(r2))
    d = np.hypot(p[:, 0] - cx, p[:, 1] - cy)
    near = np.abs(d - rr) <= tol
    angle = np.radians(np.arange(0, 360, 2))
    return Fit(True, "circle", float(rr), (float(cx), float(cy), 0.0), 100 * near.mean(), 100 * (d < rr - tol).mean(), arc_degrees(p[near, 0] - cx, p[near, 1] - cy), np.flatnonzero(near), np.c_[cx + rr * np.cos(angle), cy + rr * np.sin(angle)])


def _conic(q: np.ndarray) -> np.ndarray | None:
    """Centre, half axes and turn of the ellipse nearest to points, by the smallest eigenvector of the design's scatter."""
    m = q.mean(0)
    s = max(q.std(), 1e-12)
    x, y = ((q - m) / s).T
    d = np.c_[x * x, x * y, y * y, x, y, np.ones(len(x))]
    a, b, c, e, f, g = np.linalg.eigh(d.T @ d)[1][:, 0]
    if b * b - 4 * a * c >= -1e-12:
        return None
    cx, cy = np.linalg.solve([[2 * a, b], [b, 2 * c]], [-e, -f])
    level = -(a * cx * cx + b * cx * cy + c * cy * cy + e * cx + f * cy + g)
    w, v = np.linalg.eigh(np.array([[a, b / 2], [b / 2, c]]))
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.sqrt(level / w)
    if not np.isfinite(half).all():
        return None
    return np.array([m[0] + s * cx, m[1] + s * cy, s * half[0], s * half[1], np.arctan2(v[1, 0], v[0, 0])])


def _conics(q: np.ndarray) -> np.ndarray:
    """_conic() of many small sets of points at once; sets without an ellipse are left out."""
    m = q.mean(1, keepdims=True)
    s = np.maximum(q.std((1, 2)), 1e-12)[:, None, None]
    x, y = np.moveaxis((q - m) / s, 2, 0)
    d = np.stack([x * x, x * y, y * y, x, y, np.ones_like(x)], 2)
    a, b, c, e, f, g = np.linalg.eigh(np.swapaxes(d, 1, 2) @ d)[1][:, :, 0].T
    det = 4 * a * c - b * b
    with np.errstate(divide="ignore", invalid="ignore"):
        cx, cy = (b * f - 2 * c * e) / det, (b * e - 2 * a * f) / det
        level = -(a * cx * cx + b * cx * cy + c * cy * cy + e * cx + f * cy + g)
        w, v = np.linalg.eigh(np.stack([np.stack([a, b / 2], 1), np.stack([b / 2, c], 1)], 1))
        half = np.sqrt(level[:, None] / w)
    out = np.stack([m[:, 0, 0] + s[:, 0, 0] * cx, m[:, 0, 1] + s[:, 0, 0] * cy, s[:, 0, 0] * half[:, 0], s[:, 0, 0] * half[:, 1], np.arctan2(v[:, 1, 0], v[:, 0, 0])], 1)
    return out[(det > 1e-12) & np.isfinite(out).all(1)]


def _ellipse_off(p: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First-order distances to an ellipse, and whether points are inside."""
    c, s = np.cos(e[4]), np.sin(e[4])
    u, v = (p[:, 0] - e[0]) * c + (p[:, 1] - e[1]) * s, (p[:, 1] - e[1]) * c - (p[:, 0] - e[0]) * s
    f = (u / e[2]) ** 2 + (v / e[3]) ** 2 - 1
    slope = 2 * np.hypot(u / e[2] ** 2, v / e[3] ** 2)
    return np.abs(f) / np.maximum(slope, 1e-12), f < 0


def fit_ellipse(p: np.ndarray, tol: float, seed: int = 42) -> Fit:
    """Consensus of ellipses through five points, refitted on the inliers; axes may differ threefold at most."""
    if len(p) < 6:
        return Fit(shape_type="ellipse")
    rng = np.random.default_rng(seed)
    best, most = None, -1
    for _ in range(0, DRAWS, 250):
        five = p[np.argsort(rng.random((250, len(p))), 1)[:, :5]] if len(p) < 100 else p[rng.integers(0, len(p), (250, 5))]
        e = _conics(five)
        e = e[(e[:, 2:4].max(1) < 3 * e[:, 2:4].min(1))]
        if len(e):
            n = (_ellipse_off(p, e.T[:, :, None])[0] < tol).sum(1)
            if n.max() > most:
                best, most = e[int(n.argmax())], int(n.max())
    if best is None:
        return Fit(shape_type="ellipse")
    again = _conic(p[_ellipse_off(p, best)[0] < tol]) if most >= 6 else None
    if again is not None and max(again[2:4]) < 3 * min(again[2:4]) and (_ellipse_off(p, again)[0] < tol).sum() >= most:
        best = again
    off, inside = _ellipse_off(p, best)
    near = off < tol
    angle = np.radians(np.arange(0, 360, 2))
    c, s = np.cos(best[4]), np.sin(best[4])
    u, v = best[2] * np.cos(angle), best[3] * np.sin(angle)
    return Fit(True, "ellipse", float(np.sqrt(best[2] * best[3])), (float(best[0]), float(best[1]), 0.0), 100 * near.mean(), 100 * (inside & ~near).mean(), arc_degrees(p[near, 0] - best[0], p[near, 1] - best[1]), np.flatnonzero(near), np.c_[best[0] + u * c - v * s, best[1] + u * s + v * c])


def fit_fourier(p: np.ndarray, tol: float, order: int = 5) -> Fit:
    """The radius as a Fourier series of the angle about the centroid, by ridge least squares."""
    name = f"fourier{order}"
    if len(p) < 2 * order + 2:
        return Fit(shape_type=name)
    c = p.mean(0)
    d = p - c
    a, r = np.arctan2(d[:, 1], d[:, 0]), np.hypot(d[:, 0], d[:, 1])
    if arc_degrees(d[:, 0], d[:, 1]) < 300:
        return Fit(shape_type=name)
    s = np.sort(a)
    gaps = np.diff(np.append(s, s[0] + 2 * np.pi))
    extra = [x + np.arange(np.radians(5), g, np.radians(5)) for x, g in zip(s, gaps, strict=True) if g > np.radians(10)]
    fill = np.concatenate(extra) if extra else np.zeros(0)
    basis = lambda t: np.concatenate([np.ones((len(t), 1))] + [f(k * t)[:, None] for k in range(1, order + 1) for f in (np.cos, np.sin)], 1)
    m = basis(np.append(a, fill))
    w = np.linalg.solve(m.T @ m + 1e-9 * np.eye(m.shape[1]), m.T @ np.append(r, np.full(len(fill), np.median(r))))
    fit = basis(a) @ w
    near = np.abs(r - fit) < tol
    t = np.radians(np.arange(0, 360, 2))
    ring = np.maximum(basis(t) @ w, 0)
    xy = c + np.c_[ring * np.cos(t), ring * np.sin(t)]
    nxt = np.roll(xy, -1, 0)
    cross = xy[:, 0] * nxt[:, 1] - nxt[:, 0] * xy[:, 1]
    area = cross.sum() / 2
    if area <= 0:
        return Fit(shape_type=name)
    centre = ((xy + nxt) * cross[:, None]).sum(0) / (6 * area)
    return Fit(True, name, float(np.sqrt(area / np.pi)), (float(centre[0]), float(centre[1]), 0.0), 100 * near.mean(), 100 * (r < fit - tol).mean(), arc_degrees(d[near, 0], d[near, 1]), np.flatnonzero(near), xy)


#: Fixed values (X5): the share of the smaller circle that two may have in common, and the inliers that all need over the first's.
MULTI_OVERLAP, MULTI_GAIN = 0.2, 1.3


def _overlap(a: Fit, b: Fit) -> float:
    """Shared area of two circles by that of the smaller one."""
    d, small = float(np.hypot(a.center[0] - b.center[0], a.center[1] - b.center[1])), min(a.radius, b.radius)
    if d >= a.radius + b.radius or small <= 0:
        return 0.0
    if d <= abs(a.radius - b.radius):
        return 1.0
    parts = [r * r * np.arccos(np.clip((d * d + r * r - o * o) / (2 * d * r), -1, 1)) for r, o in ((a.radius, b.radius), (b.radius, a.radius))]
    kite = 0.5 * np.sqrt(max(0.0, (-d + a.radius + b.radius) * (d + a.radius - b.radius) * (d - a.radius + b.radius) * (d + a.radius + b.radius)))
    return float((sum(parts) - kite) / (np.pi * small**2))


def fit_multi(p: np.ndarray, tol: float, n: int = 2) -> Fit:
    """Up to n circles one after the other on what is left; the radius is that of the circle of their summed area."""
    rest, found, used = np.arange(len(p)), [], np.zeros(len(p), bool)
    for i in range(n):
        one = fit_circle(p[rest], tol, 64 + i) if len(rest) >= 3 else Fit()
        if not one.success or len(one.inliers) < max(10, 0.1 * len(p)):
            break
        if any(_overlap(one, f) > MULTI_OVERLAP for f in found):
            break
        found.append(one)
        used[rest[one.inliers]] = True
        rest = np.flatnonzero(~used)
    if len(found) < n or used.sum() < MULTI_GAIN * len(found[0].inliers):
        return Fit(shape_type=f"multi{n}")
    r = float(np.sqrt(sum(f.radius**2 for f in found)))
    w = np.array([f.radius**2 for f in found])
    c = (np.array([f.center[:2] for f in found]) * w[:, None]).sum(0) / w.sum()
    return Fit(True, f"multi{n}", r, (float(c[0]), float(c[1]), 0.0), 100 * used.mean(), 0.0, min(f.arc_deg for f in found), np.flatnonzero(used), np.concatenate([f.contour for f in found]))


#: Fixed values (X6): the shapes that each complexity tries, in order.
STRATEGIES = {"basic": ("circle",), "standard": ("circle", "ellipse", "fourier5"), "buttress": ("circle", "ellipse", "fourier5", "fourier10"), "full": ("circle", "ellipse", "fourier5", "multi2", "multi3", "fourier10")}


def fit(xyz: np.ndarray, tol: float = 0.04, strategy: str = "standard", start=None, end=None) -> Fit:
    """The cross-section's shape; a later one wins if it has over 1.1 times the inliers of the best before."""
    xyz = np.asarray(xyz, float)
    at = xyz.mean(0) if start is None else np.asarray(start, float)
    m = np.array(rotation_to_z(tuple(np.asarray(end, float) - np.asarray(start, float)))) if start is not None else np.eye(3)
    q = (xyz - at) @ m.T
    p = q[:, :2]
    best = Fit()
    for name in STRATEGIES[strategy]:
        f = {"circle": lambda: fit_circle(p, tol), "ellipse": lambda: fit_ellipse(p, tol), "fourier5": lambda: fit_fourier(p, tol, 5), "fourier10": lambda: fit_fourier(p, tol, 10), "multi2": lambda: fit_multi(p, tol, 2), "multi3": lambda: fit_multi(p, tol, 3)}[name]()
        if f.success and (not best.success or f.inlier_pct > 1.1 * best.inlier_pct):
            best = f
        if best.inlier_pct * 1.1 >= 100:  # no shape can beat it by enough
            break
    if best.success:
        best.center = tuple(np.array([*best.center[:2], q[:, 2].mean()]) @ m + at)
    return best


FIT_SCHEMA = "success boolean, shape_type string, radius double, center_x double, center_y double, center_z double, inlier_pct double, interior_pct double, arc_deg double, n long"


def fit_groups(points: DataFrame, key: str, tol: float = 0.04, strategy: str = "standard") -> DataFrame:
    """A fit for every group of points (key, X, Y, Z)."""
    kind = points.schema[key].dataType.simpleString()

    def run(name, pdf):
        f = fit(pdf[["X", "Y", "Z"]].to_numpy(), tol, strategy)
        return pd.DataFrame([[name[0], f.success, f.shape_type, f.radius, *f.center, f.inlier_pct, f.interior_pct, f.arc_deg, len(pdf)]], columns=[key, *(c.split()[0] for c in FIT_SCHEMA.split(", "))])

    return points.select(key, "X", "Y", "Z").groupBy(key).applyInPandas(run, f"{key} {kind}, {FIT_SCHEMA}")
