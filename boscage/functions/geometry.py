"""Scalar geometry and allometry as column expressions.  Nothing here leaves code generation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def length() -> Column:
    """Length of a cylinder's axis."""
    return F.sqrt((C("endX") - C("startX")) ** 2 + (C("endY") - C("startY")) ** 2 + (C("endZ") - C("startZ")) ** 2)


def volume(radius: Column | None = None) -> Column:
    """Pi r^2 L; an unset radius counts as none."""
    r = F.coalesce(C("radius") if radius is None else radius, F.lit(0.0))
    return F.pi() * r * r * length()


def inclination() -> Column:
    """Degrees between the axis and the vertical, 0 for a point."""
    n = length()
    return F.when(n < 1e-6, 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (C("endZ") - C("startZ")) / n)))))


def axis_position(x: Column, y: Column, z: Column) -> Column:
    """Position of a point's foot on the cylinder's axis, 0 at its start and 1 at its end."""
    dx, dy, dz = C("endX") - C("startX"), C("endY") - C("startY"), C("endZ") - C("startZ")
    n2 = dx * dx + dy * dy + dz * dz
    return F.when(n2 < 1e-24, 0.0).otherwise(((x - C("startX")) * dx + (y - C("startY")) * dy + (z - C("startZ")) * dz) / n2)


def _off_axis(x: Column, y: Column, z: Column, t: Column) -> Column:
    at = [C(f"start{a}") + t * (C(f"end{a}") - C(f"start{a}")) for a in "XYZ"]
    return F.sqrt((x - at[0]) ** 2 + (y - at[1]) ** 2 + (z - at[2]) ** 2)


def segment_distance(x: Column, y: Column, z: Column) -> Column:
    """Distance to the axis segment less the radius, 0 inside."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), axis_position(x, y, z)))
    return F.greatest(F.lit(0.0), _off_axis(x, y, z, t) - F.coalesce(C("radius"), F.lit(0.0)))


def surface_distance(x: Column, y: Column, z: Column) -> Column:
    """Distance to the cylinder with flat caps, 0 inside."""
    t, r = axis_position(x, y, z), F.coalesce(C("radius"), F.lit(0.0))
    rho = _off_axis(x, y, z, t)
    beyond = F.when(t < 0, -t).otherwise(t - 1) * length()
    out = F.greatest(F.lit(0.0), rho - r)
    return F.when((t >= 0) & (t <= 1), out).when(rho <= r, beyond).otherwise(F.sqrt(beyond * beyond + out * out))


def _off_axes(pairs: DataFrame, point: tuple[str, str, str], clamp: bool) -> DataFrame:
    """pairs with _n2 (squared length of the axis), _t (axis_position(), clamped to the segment) and _rho (distance to it)."""
    d = pairs.withColumns({f"_d{a}": C(f"end{a}") - C(f"start{a}") for a in "XYZ"} | {f"_o{a}": C(p) - C(f"start{a}") for a, p in zip("XYZ", point, strict=True)})
    d = d.withColumn("_n2", C("_dX") * C("_dX") + C("_dY") * C("_dY") + C("_dZ") * C("_dZ"))
    d = d.withColumn("_t", F.when(C("_n2") < 1e-24, 0.0).otherwise((C("_oX") * C("_dX") + C("_oY") * C("_dY") + C("_oZ") * C("_dZ")) / C("_n2")))
    if clamp:
        d = d.withColumn("_t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), C("_t"))))
    d = d.withColumns({f"_f{a}": C(f"_o{a}") - C("_t") * C(f"_d{a}") for a in "XYZ"})
    return d.withColumn("_rho", F.sqrt(C("_fX") * C("_fX") + C("_fY") * C("_fY") + C("_fZ") * C("_fZ")))


def with_segment_distance(pairs: DataFrame, x: str, y: str, z: str, name: str = "dist") -> DataFrame:
    """Pairs of points and cylinders with segment_distance() as a column, each part worked out once a pair."""
    d = _off_axes(pairs, (x, y, z), True)
    return d.select(*pairs.columns, F.greatest(F.lit(0.0), C("_rho") - F.coalesce(C("radius"), F.lit(0.0))).alias(name))


def with_surface_distance(pairs: DataFrame, x: str, y: str, z: str, name: str = "dist") -> DataFrame:
    """Pairs of points and cylinders with surface_distance() as a column, each part worked out once a pair; in one
    expression they are repeated until the method is too large to be compiled."""
    d = _off_axes(pairs, (x, y, z), False)
    d = d.withColumns({"_in": C("_rho") - F.coalesce(C("radius"), F.lit(0.0)), "_past": F.greatest(-C("_t"), C("_t") - 1) * F.sqrt(C("_n2"))})
    d = d.withColumn("_out", F.greatest(F.lit(0.0), C("_in")))
    dist = F.when(C("_past") <= 0, C("_out")).when(C("_in") <= 0, C("_past")).otherwise(F.sqrt(C("_past") * C("_past") + C("_out") * C("_out")))
    return d.select(*pairs.columns, dist.alias(name))


def rotation_to_z(axis: tuple[float, float, float]) -> list[list[float]]:
    """P10: the rotation matrix that takes `axis` to the vertical; half a turn about x for the opposite direction."""
    n = math.sqrt(sum(a * a for a in axis))
    x, y, z = (a / n for a in axis)
    s2 = x * x + y * y
    if s2 < 1e-24:
        return [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]] if z > 0 else [[1.0, 0, 0], [0, -1.0, 0], [0, 0, -1.0]]
    # I + K + K^2 (1-c)/s^2 for the axis (x, y, z) x (0, 0, 1) = (y, -x, 0)
    f = (1 - z) / s2
    return [[1 - f * x * x, -f * x * y, -x], [-f * x * y, 1 - f * y * y, -y], [x, y, z]]


def rotated(x: Column, y: Column, z: Column, m: list[list[float]]) -> tuple[Column, Column, Column]:
    return tuple(x * r[0] + y * r[1] + z * r[2] for r in m)  # type: ignore[return-value]


def circumcircle(p: list[tuple[Column, Column]]) -> Column:
    """struct(cx, cy, r) of the circle through three points; null where they are in line."""
    (ax, ay), (bx, by), (cx, cy) = p
    det = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    sq = [x * x + y * y for x, y in p]
    ux = (sq[0] * (by - cy) + sq[1] * (cy - ay) + sq[2] * (ay - by)) / det
    uy = (sq[0] * (cx - bx) + sq[1] * (ax - cx) + sq[2] * (bx - ax)) / det
    return F.when(F.abs(det) >= 1e-12, F.struct(ux.alias("cx"), uy.alias("cy"), F.sqrt((ax - ux) ** 2 + (ay - uy) ** 2).alias("r")))


def circle_residual(x: Column, y: Column, cx: Column, cy: Column, r: Column) -> Column:
    """Distance of a point to a circle."""
    return F.abs(F.sqrt((x - cx) ** 2 + (y - cy) ** 2) - r)


def lens_area(d: Column, r1: Column, r2: Column) -> Column:
    """Area that two circles at distance d share."""
    clamp = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    a = r1 * r1 * F.acos(clamp((d * d + r1 * r1 - r2 * r2) / (2 * d * r1)))
    b = r2 * r2 * F.acos(clamp((d * d + r2 * r2 - r1 * r1) / (2 * d * r2)))
    k = 0.5 * F.sqrt(F.greatest(F.lit(0.0), (r1 + r2 - d) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2)))
    small = F.least(r1, r2)
    return F.when(d >= r1 + r2, 0.0).when(d <= F.abs(r1 - r2), F.pi() * small * small).otherwise(a + b - k)


def lens_ratio(d: Column, r1: Column, r2: Column) -> Column:
    """Shared area by the area of the smaller circle."""
    small = F.least(r1, r2)
    return F.when(small > 0, lens_area(d, r1, r2) / (F.pi() * small * small)).otherwise(0.0)


def penalty(degrees: Column) -> Column:
    """Cost factor of a step that deviates so many (rounded) degrees from upwards."""
    d = F.rint(degrees)
    return F.when(d > 100, 100.0).otherwise(F.exp(d * 0.046051))


def conic_radius(w: Column, w0: Column, r0: Column, tip: Column) -> Column:
    """Conic allometry."""
    return F.when(w0 == 0, tip).otherwise(tip + F.pow(w / w0, F.lit(1.1)) * (r0 - tip))


def circle_valid(r: Column, arc: Column, inlier: Column, inside: Column) -> Column:
    """Which fitted circles count as stems."""
    wide = F.when(r < 0.1, (arc > 130) & (inlier > 60)).otherwise((arc > 140) & (inlier > 40))
    return (r >= 0.02) & (r <= 2) & F.when(r < 0.05, (arc > 180) & (inlier > 30)).otherwise((inside <= 20) & wide)


#: Fixed values (P22): least radius, least arc, least share of inliers, largest share a known radius may shrink by.
PRESETS = {"low": (0.0, 120.0, 50.0, 1.0), "standard": (0.03, 180.0, 30.0, 1.0), "accurate": (0.0, 300.0, 70.0, 0.1), "accurate_large": (0.06, 300.0, 70.0, 1.0)}


def fit_accepted(success: Column, r: Column, arc: Column, inlier: Column, preset: str = "standard", known: Column | None = None) -> Column:
    """Whether a fit is accepted; against a known radius it may not shrink by more than the preset allows."""
    least_r, least_arc, least_in, shrink = PRESETS[preset]
    good = success & (r >= least_r) & (arc > least_arc) & (inlier > least_in)
    if known is None or shrink >= 1:
        return good
    return good & (F.coalesce(known <= 0, F.lit(True)) | ((r - known) / known >= -shrink))


def fit_score(arc: Column, inlier: Column) -> Column:
    return arc / 360 * inlier / 100


#: Fixed values (P19): coefficients of the published height models; diameters in centimetres.
GRIESE_A, GRIESE_B, GRIESE_C, GRIESE_LINEAR = 36.03, 0.05, 1.1, 35.5
COSTA = (1.029, 0.567)
CHENGE = (5.135, 0.451)
ALLOMETRIES = ("Griese2025", "Chenge2020", "CostaCysneiros2020", "Cacao")


def dbh_of_height(h: Column, model: str = "Griese2025") -> Column:
    """Breast-height diameter in metres from height in metres.

    The Chapman-Richards curve is inverted below GRIESE_LINEAR and goes on along its tangent above.
    """
    if model in ("Griese2025", "Cacao"):
        times = 3.0 if model == "Cacao" else 1.0
        curve = -F.log(1 - F.pow(h / GRIESE_A, F.lit(1 / GRIESE_C))) / GRIESE_B
        at = -math.log(1 - (GRIESE_LINEAR / GRIESE_A) ** (1 / GRIESE_C)) / GRIESE_B
        fall = math.exp(-GRIESE_B * at)
        slope = 1 / (GRIESE_A * GRIESE_C * (1 - fall) ** (GRIESE_C - 1) * GRIESE_B * fall)
        return F.when(h < GRIESE_LINEAR, curve).otherwise(at + slope * (h - GRIESE_LINEAR)) / 100 * times
    if model == "CostaCysneiros2020":
        return F.exp((F.log(h) - COSTA[0]) / COSTA[1]) / 100
    if model == "Chenge2020":
        return F.pow(h / CHENGE[0], F.lit(1 / CHENGE[1])) / 100
    raise ValueError(f"unknown allometry {model}")


def height_of_dbh(d: Column, model: str = "Griese2025") -> Column:
    """Height in metres; the diameter is in centimetres for Griese2025 and Cacao, in metres for the others."""
    if model in ("Griese2025", "Cacao"):
        return GRIESE_A * F.pow(1 - F.exp(-GRIESE_B * d), F.lit(GRIESE_C))
    if model == "CostaCysneiros2020":
        return math.exp(COSTA[0]) * F.pow(d * 100, F.lit(COSTA[1]))
    if model == "Chenge2020":
        return CHENGE[0] * F.pow(d * 100, F.lit(CHENGE[1]))
    raise ValueError(f"unknown allometry {model}")


def legacy_dbh_of_height(h: Column) -> Column:
    """P20: the older model, in centimetres: the inverse curve below 25 m, a straight line above."""
    return F.when(h < 25, -F.log(1 - F.pow(h / GRIESE_A, F.lit(1 / GRIESE_C))) / GRIESE_B).otherwise(4 * h - 75)


def available_allometries() -> list[str]:
    return list(ALLOMETRIES)


def hcl_to_rgb(h: Column, c: Column, lum: Column) -> Column:
    """struct(r, g, b) bytes of a CIE LCh(ab) colour."""
    a, b = c * F.cos(F.radians(h)), c * F.sin(F.radians(h))
    fy = (lum + 16) / 116
    xyz = []
    for f, white in ((fy + a / 500, 0.95047), (fy, 1.0), (fy - b / 200, 1.08883)):
        xyz.append(F.when(f > 6 / 29, f * f * f).otherwise(3 * (6 / 29) ** 2 * (f - 4 / 29)) * white)
    rows = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))
    out = []
    for row, name in zip(rows, "rgb", strict=True):
        v = reduce(lambda p, q: p + q, (x * k for x, k in zip(xyz, row, strict=True)))
        v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
        v = F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
        out.append(F.rint(v * 255).cast("int").alias(name))
    return F.struct(*out)


def clean_crs(wkt: Column) -> Column:
    """White space collapsed, none around brackets and commas."""
    return F.trim(F.regexp_replace(F.regexp_replace(wkt, r"[ \t\r\n]+", " "), r" ?([\[\],]) ?", "$1"))


def message_tag(message: Column) -> Column:
    """The text in a message's leading brackets."""
    return F.regexp_extract(message, r"^\[([^\]]+)\]", 1)


def voxel(axis: Column, least: Column | float, size: float) -> Column:
    return F.floor((axis - least) / size).cast("long")
