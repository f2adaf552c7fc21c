"""Operators over cylinder tables of trees: folds, architecture, statistics, radii.

A table has one row per cylinder: tree_id, cyl_ID, parent_ID, start and end, radius (null if unset).  Folds run in one
Arrow task a tree (operators.folds), so each costs one shuffle by tree_id whatever the trees' depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boscage.functions.geometry import conic_radius, length, message_tag, volume
from boscage.operators.folds import FOLDS, fold_trees

KEY = ["tree_id"]


def dist_to_root(cylinders: DataFrame) -> DataFrame:
    """Path length from the root to each cylinder's start."""
    return fold_trees(cylinders, "dist_to_root")


def subtree(cylinders: DataFrame) -> DataFrame:
    """subtree_length, subtree_max_z and subtree_volume (longest by volume, not the sum) of each cylinder."""
    return fold_trees(cylinders, "subtree_length", "subtree_max_z", "subtree_volume")


def architecture(cylinders: DataFrame, by_volume: bool = False) -> DataFrame:
    """branch_order (1 along main children) and axis (the cylinder that heads the axis).

    A node's main child is the one whose subtree reaches highest, or holds most volume along its way, then the longest,
    then the smallest id.
    """
    return fold_trees(cylinders, "branch_order", "axis", by_volume=by_volume)


def grown(cylinders: DataFrame) -> DataFrame:
    """All folds at once: one shuffle for what dist_to_root, subtree and architecture tell."""
    return fold_trees(cylinders, *(f for f in FOLDS if f not in ("parent", "reached")))


def family(cylinders: DataFrame) -> DataFrame:
    """(tree_id, cyl_ID, parent, children, root): parent is null at a root, which is where root is true."""
    t = fold_trees(cylinders, "parent").select("tree_id", "cyl_ID", "parent")
    below = t.where("parent is not null").groupBy("tree_id", F.col("parent").alias("cyl_ID")).agg(F.array_sort(F.collect_list("cyl_ID")).alias("children"))
    return t.join(below, ["tree_id", "cyl_ID"], "left").select("tree_id", "cyl_ID", "parent", F.coalesce("children", F.array().cast("array<long>")).alias("children"), F.col("parent").isNull().alias("root"))


def validate(cylinders: DataFrame) -> DataFrame:
    """Per tree its cylinders, roots (parents that are no cylinder), cylinders that no root reaches, unset radii, and
    whether it is one connected tree whose radii are all set.  A table without rows has no tree and gives none."""
    t = fold_trees(cylinders, "parent", "reached").groupBy("tree_id").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("parent").isNull(), F.col("parent_ID"))).alias("roots"), F.count_if(~F.col("reached")).alias("unreached"), F.count_if(F.col("radius").isNull() | F.isnan("radius")).alias("unset"))
    return t.withColumn("valid", (F.col("roots") == 1) & (F.col("unreached") == 0) & (F.col("unset") == 0))


def remove_disconnected(cylinders: DataFrame) -> DataFrame:
    """Cylinders that a root reaches; those on or behind a cycle, or of a root other than the first, go.

    The first root is the parent of the smallest cylinder without one.
    """
    heads = fold_trees(cylinders, "parent").where("parent is null").select("tree_id", F.col("cyl_ID").alias("root_id"), "parent_ID")
    first = heads.groupBy("tree_id").agg(F.min_by("parent_ID", "root_id").alias("first"))
    kept = heads.join(first, "tree_id").where("parent_ID = first").select(F.col("tree_id").alias("tree"), "root_id")
    own = root_of(cylinders).join(kept, ["tree", "root_id"], "left_semi").select(F.col("tree").alias("tree_id"), "cyl_ID")
    return cylinders.join(own, ["tree_id", "cyl_ID"], "left_semi")


def root_of(cylinders: DataFrame) -> DataFrame:
    """(tree, cyl_ID, root_id): the root cylinder above each one."""
    import numpy as np
    import pyarrow as pa

    from boscage.operators.folds import depths, parents

    def run(table: pa.Table) -> pa.Table:
        ident, above = (np.asarray(table[c].cast(pa.int64())) for c in ("cyl_ID", "parent_ID"))
        up = parents(ident, above)
        _, reached = depths(up)
        at = np.where(up < 0, np.arange(len(up)), up)
        for _ in range(len(up).bit_length() + 1):
            at = at[at]
        return pa.table({"tree": table["tree_id"].cast(pa.int64()), "cyl_ID": pa.array(ident), "root_id": pa.array(ident[at], pa.int64(), mask=~reached)})

    return cylinders.select("tree_id", "cyl_ID", "parent_ID").groupBy("tree_id").applyInArrow(run, "tree long, cyl_ID long, root_id long")


def fix_multiple_root(cylinders: DataFrame, below: float = 0.01) -> DataFrame:
    """Where several cylinders start at a tree's root, one more below them: from `below` under their lowest start to
    it, numbered one below the smallest id, the parent of all of them.  Other columns of the new row are null."""
    heads = fold_trees(cylinders, "parent").where("parent is null")
    low = heads.groupBy("tree_id").agg(F.count("*").alias("n"), F.min(F.struct("startZ", "cyl_ID", "startX", "startY")).alias("s")).where("n > 1").join(cylinders.groupBy("tree_id").agg(F.least(F.min("cyl_ID"), F.min("parent_ID"), F.lit(0)).alias("least")), "tree_id")
    new = low.select("tree_id", (F.col("least") - 1).alias("cyl_ID"), (F.col("least") - 2).alias("parent_ID"), F.col("s.startX").alias("startX"), F.col("s.startY").alias("startY"), (F.col("s.startZ") - below).alias("startZ"), F.col("s.startX").alias("endX"), F.col("s.startY").alias("endY"), F.col("s.startZ").alias("endZ"))
    kinds = dict(cylinders.dtypes)
    new = new.select(*[F.col(c).cast(kinds[c]) for c in new.columns])
    hung = heads.select("tree_id", "cyl_ID").join(new.select("tree_id", F.col("cyl_ID").alias("_new")), "tree_id")
    moved = cylinders.join(hung, ["tree_id", "cyl_ID"], "left").withColumn("parent_ID", F.coalesce("_new", "parent_ID")).drop("_new").select(*cylinders.columns)
    return moved.unionByName(new, allowMissingColumns=True)


def stem(cylinders: DataFrame) -> DataFrame:
    """F17."""
    return cylinders.where("branch_order = 1")


def nostump(cylinders: DataFrame, h: float = 0.15) -> DataFrame:
    """F19."""
    return cylinders.withColumn("radius", F.when(F.col("dist_to_root") < h, 0.0).otherwise(F.col("radius")))


def merchantable(cylinders: DataFrame, r: float = 0.045, least: float = 1.0) -> DataFrame:
    """Cylinders with a radius above r in their subtree, on axes that keep that length (`axis` heads them)."""
    kept = fold_trees(cylinders, "subtree_radius").where(F.col("subtree_radius") > r).drop("subtree_radius")
    axes = kept.groupBy("tree_id", "axis").agg(F.sum(length()).alias("kept")).where(F.col("kept") >= least).drop("kept")
    return kept.join(axes, ["tree_id", "axis"], "left_semi")


def dbh(cylinders: DataFrame, bh: float = 1.3) -> DataFrame:
    """(tree_id, dbh, x, y, z): diameter and place at height bh along the axis of order 1, interpolated between starts.

    Below the first or beyond the last start the end's own diameter is given (not its radius: the clamp is mended).
    """
    w = Window.partitionBy("tree_id").orderBy("d", "cyl_ID")
    t = cylinders.where("branch_order = 1 and radius is not null").select("tree_id", "cyl_ID", F.col("dist_to_root").alias("d"), "radius", "startX", "startY", "startZ")
    t = t.withColumns({"d2": F.lead("d").over(w), "r2": F.lead("radius").over(w), "x2": F.lead("startX").over(w), "y2": F.lead("startY").over(w), "z2": F.lead("startZ").over(w), "rn": F.row_number().over(w)})
    first, last = (F.col("rn") == 1) & (F.col("d") > bh), F.col("d2").isNull() & (F.col("d") <= bh)
    t = t.where(first | last | ((F.col("d") <= bh) & (F.col("d2") > bh)))
    f = F.when(first | last, 0.0).otherwise((bh - F.col("d")) / (F.col("d2") - F.col("d")))
    mid = lambda a, b: F.col(a) + f * (F.coalesce(b, a) - F.col(a))
    return t.select("tree_id", (2 * mid("radius", "r2")).alias("dbh"), mid("startX", "x2").alias("x"), mid("startY", "y2").alias("y"), mid("startZ", "z2").alias("z"))


def stem_taper(cylinders: DataFrame) -> DataFrame:
    """(tree_id, distance, diameter) along axis 1."""
    most = F.max("subtree_length").over(Window.partitionBy("tree_id"))
    return cylinders.where("branch_order = 1").select("tree_id", "cyl_ID", (most - F.col("subtree_length")).alias("distance"), (2 * F.col("radius")).alias("diameter"))


def stats_radius(cylinders: DataFrame) -> DataFrame:
    """Volume and number of cylinders by classes of two centimetres of radius, named by their upper end."""
    c = cylinders.withColumn("class_cm", F.ceil(F.col("radius") * 100 / 2).cast("long") * 2)
    return c.groupBy("tree_id", "class_cm").agg(F.round(F.sum(volume()), 3).alias("volume"), F.count("*").alias("n"))


def stats_order(cylinders: DataFrame) -> DataFrame:
    """Volume by branch order with its running percentage."""
    v = cylinders.groupBy("tree_id", "branch_order").agg(F.round(F.sum(volume()), 3).alias("volume"))
    w = Window.partitionBy("tree_id").orderBy("branch_order").rowsBetween(Window.unboundedPreceding, 0)
    return v.withColumn("percent", F.round(F.sum("volume").over(w) / F.sum("volume").over(Window.partitionBy("tree_id")) * 100, 1))


def stats_global(cylinders: DataFrame, bh: float = 1.3) -> DataFrame:
    """Root, diameter at breast height, volume and height of each tree."""
    root = F.min(F.when(F.col("branch_order") == 1, F.struct("dist_to_root", "cyl_ID", "startX", "startY", "startZ"))).alias("r")
    t = cylinders.groupBy("tree_id").agg(root, F.round(F.sum(volume()), 3).alias("V"), F.max("endZ").alias("top"))
    d = dbh(cylinders, bh).select("tree_id", F.col("dbh").alias("DBH"), F.col("x").alias("X_bh"), F.col("y").alias("Y_bh"), F.col("z").alias("Z_bh"))
    return t.join(d, "tree_id", "left").select("tree_id", F.col("r.startX").alias("X_root"), F.col("r.startY").alias("Y_root"), F.col("r.startZ").alias("Z_root"), "X_bh", "Y_bh", "Z_bh", "DBH", "V", F.round(F.col("top") - F.col("r.startZ"), 3).alias("H"))


def qsf_merchantable(stats: DataFrame, r: float = 0.045) -> DataFrame:
    """trees whose radius at breast height exceeds r."""
    return stats.where(F.col("DBH") / 2 > r)


def forest_report(stats: DataFrame) -> DataFrame:
    """Number of trees, area of the box of roots rounded to 50, figures per hectare, and the number of the largest
    trees that hold half of the volume."""
    a = stats.agg(F.count("*").alias("n"), (F.round((F.max("X_root") - F.min("X_root")) * (F.max("Y_root") - F.min("Y_root")) / 50) * 50).alias("area"), F.sum(F.pi() * (F.col("DBH") / 2) ** 2).alias("ba"), F.avg("DBH").alias("mean_dbh"), F.avg("H").alias("mean_h"), F.sum("V").alias("volume"))
    per = lambda c: F.when(F.col("area") > 0, F.col(c) / F.col("area") * 10000)
    out = a.crossJoin(F.broadcast(half_volume(stats)))  # one row each
    return out.select("n", "area", per("n").alias("density_ha"), per("ba").alias("ba_ha"), "mean_dbh", "mean_h", "volume", "half")


def half_volume(stats: DataFrame) -> DataFrame:
    """(half): how many of the largest trees it takes to hold half of the volume.

    Volumes, rounded to litres, are counted first, so the running sum goes over distinct volumes and not over trees.
    """
    v = stats.where("V > 0").groupBy(F.round("V", 3).alias("v")).agg(F.count("*").alias("k"))
    down = Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    t = v.withColumns({"before": F.coalesce(F.sum(F.col("v") * F.col("k")).over(down), F.lit(0.0)), "trees": F.coalesce(F.sum("k").over(down), F.lit(0)), "half": F.sum(F.col("v") * F.col("k")).over(Window.partitionBy(F.lit(1))) / 2})
    reach = t.where((F.col("before") < F.col("half")) & (F.col("before") + F.col("v") * F.col("k") >= F.col("half")))
    return reach.agg(F.max(F.col("trees") + F.ceil(F.round((F.col("half") - F.col("before")) / F.col("v"), 9))).alias("half"))


def log_tags(messages: DataFrame) -> DataFrame:
    """(type, trees, n): ids of the trees with a message of each tag; messages is (tree_id, message)."""
    t = messages.select("tree_id", message_tag(F.col("message")).alias("type")).where("type <> ''")
    return t.groupBy("type").agg(F.array_sort(F.collect_set("tree_id")).alias("trees"), F.count("*").alias("n"))


def ring(cylinders: DataFrame, bh: float = 1.3) -> DataFrame:
    """The trunk cylinder whose running length comes nearest to bh, with its midpoint and a centimetre more radius."""
    w = Window.partitionBy("tree_id").orderBy("cyl_ID")
    t = cylinders.where("branch_order = 1").withColumn("off", F.round(F.abs(F.sum(length()).over(w.rowsBetween(Window.unboundedPreceding, 0)) - bh), 9))
    best = t.withColumn("rn", F.row_number().over(Window.partitionBy("tree_id").orderBy("off", "cyl_ID"))).where("rn = 1")
    return best.select("tree_id", "cyl_ID", *[((F.col(f"start{a}") + F.col(f"end{a}")) / 2).alias(a.lower()) for a in "XYZ"], (F.col("radius") + 0.01).alias("radius"))


def weird_butt(cylinders: DataFrame, degrees: float = 50, run: int = 4) -> DataFrame:
    """W7's index: (tree_id, first): the first trunk cylinder that starts `run` in a row all tilted less than `degrees`."""
    from boscage.functions.geometry import inclination

    order = Window.partitionBy("tree_id").orderBy("dist_to_root", "cyl_ID")
    t = cylinders.where("branch_order = 1").withColumns({"most": F.max(inclination()).over(order.rowsBetween(0, run - 1)), "left": F.count("*").over(order.rowsBetween(0, run - 1)), "rn": F.row_number().over(order)})
    return t.where((F.col("left") == run) & (F.col("most") < degrees)).groupBy("tree_id").agg(F.min_by("cyl_ID", "rn").alias("first"))


def drop_butt(cylinders: DataFrame, degrees: float = 50, run: int = 4) -> DataFrame:
    """Trees without the trunk before weird_butt's first cylinder and without what does not grow from that cylinder, their new root.

    A tree with fewer than five trunk cylinders, without such a run or with it at its root stays as it is.
    """
    enough = cylinders.where("branch_order = 1").groupBy("tree_id").agg(F.count("*").alias("trunk"), F.min_by("cyl_ID", F.struct("dist_to_root", "cyl_ID")).alias("head")).where("trunk >= 5")
    first = weird_butt(cylinders, degrees, run).join(enough, "tree_id").where("first <> head").select("tree_id", "first")
    t = cylinders.join(first, "tree_id", "left")
    # the new root is cut off from what is above it; what hangs on the old root goes with it
    own = t.withColumn("parent_ID", F.when(F.col("first") == F.col("cyl_ID"), F.lit(None)).otherwise(F.col("parent_ID")))
    root = root_of(own.withColumn("parent_ID", F.coalesce("parent_ID", F.lit(-(1 << 62)))))
    kept = t.join(root.withColumnRenamed("tree", "tree_id"), ["tree_id", "cyl_ID"]).where("first is null or root_id = first")
    return kept.withColumn("parent_ID", F.when(F.col("first") == F.col("cyl_ID"), 0).otherwise(F.col("parent_ID"))).select(*cylinders.columns)


def conic(cylinders: DataFrame, r0: float, tip: float = 0.0025) -> DataFrame:
    """Every radius from conic allometry against the root's subtree length; a tree of one cylinder gets r0."""
    w = Window.partitionBy("tree_id")
    return cylinders.withColumn("radius", F.when(F.count("*").over(w) == 1, r0).otherwise(conic_radius(F.col("subtree_length"), F.max("subtree_length").over(w), F.lit(r0), F.lit(tip))))


#: Where a radius comes from.
UNKNOWN, PROLONGED, CONIC, POLYNOMIAL, MEASURED, REFINED = range(6)


def _taper(measured: Column, w, tip: float | Column) -> tuple[Column, Column]:
    """(a, b) of r(x) = tip + a x + b x^2 over the measured cylinders of a window, whose slope vanishes at the largest x."""
    x, y = F.when(measured, F.col("subtree_length")), F.when(measured, F.col("radius") - tip)
    xm = F.max(x).over(w)
    total = lambda v: F.sum(v).over(w)
    x1, x2, x3, x4, xy, x2y = (total(v) for v in (x, x * x, x * x * x, x * x * x * x, x * y, x * x * y))
    del x1
    zz, zy = x4 - 4 * xm * x3 + 4 * xm * xm * x2, x2y - 2 * xm * xy
    det = x2 * x4 - x3 * x3
    flat, bad = zz < 1e-12, F.abs(det) < 1e-12
    b = F.when(~flat, zy / zz).when(bad, 0.0).otherwise((x2y * x2 - xy * x3) / det)
    return F.when(~flat, -2 * b * xm).when(bad, 0.0).otherwise((xy * x4 - x2y * x3) / det), b


def taper_sums(cylinders: DataFrame, tip: float = 0.0025) -> DataFrame:
    """The (a, b) of each axis with more than six measured cylinders beyond 1.3 m from the root."""
    w = Window.partitionBy("tree_id", "axis_ID")
    ok = F.col("radius").isNotNull() & (F.col("dist_to_root") > 1.3)
    a, b = _taper(ok, w, tip)
    t = cylinders.withColumns({"a": a, "b": b, "n": F.count_if(ok).over(w)})
    return t.where("n > 6").select("tree_id", "axis_ID", "a", "b", "n").distinct()


def polynomial_fitting(cylinders: DataFrame, tip: float = 0.0025) -> DataFrame:
    """Radii of each axis from its taper; one shuffle by (tree_id, axis_ID).

    Measured are set radii beyond 1.3 m from the root.  An axis with six of them or fewer loses its radii; on others,
    down to the last measured subtree length, radii that are unset, or not refined and over 30 % off, are replaced.
    """
    w = Window.partitionBy("tree_id", "axis_ID")
    ok = F.col("radius").isNotNull() & F.col("subtree_length").isNotNull() & (F.col("dist_to_root") > 1.3)
    a, b = _taper(ok, w, tip)
    t = cylinders.withColumns({"_a": a, "_b": b, "_n": F.count_if(ok).over(w), "_last": F.min(F.when(ok, F.col("subtree_length"))).over(w)})
    guess = F.col("_a") * F.col("subtree_length") + F.col("_b") * F.col("subtree_length") ** 2 + tip
    new = (F.col("subtree_length") >= F.col("_last")) & (F.col("radius").isNull() | ((F.abs(F.col("radius") - guess) > 0.3 * guess) & (F.col("quality") < REFINED)))
    few = F.col("_n") <= 6
    quality = F.when(few, UNKNOWN).when(new, POLYNOMIAL).otherwise(F.col("quality")).cast(dict(cylinders.dtypes)["quality"])
    return t.withColumns({"radius": F.when(few, F.lit(None)).when(new, guess).otherwise(F.col("radius")), "quality": quality}).select(*cylinders.columns)


def polynomial_fitting_root(cylinders: DataFrame) -> DataFrame:
    """The same for the trunk's first 1.3 m, through the origin, from five measured radii on; others stay."""
    w = Window.partitionBy("tree_id")
    ok = (F.col("axis_ID") == 1) & F.col("radius").isNotNull() & (F.col("dist_to_root") <= 1.3)
    a, b = _taper(ok, w, 0.0)
    t = cylinders.withColumns({"_a": a, "_b": b, "_n": F.count_if(ok).over(w), "_last": F.min(F.when(ok, F.col("subtree_length"))).over(w)})
    guess = F.col("_a") * F.col("subtree_length") + F.col("_b") * F.col("subtree_length") ** 2
    off = (F.abs(F.col("radius") - guess) > 0.3 * guess) & (F.col("quality") < REFINED) & (F.col("dist_to_root") <= 1.3)
    new = (F.col("axis_ID") == 1) & (F.col("_n") > 4) & (F.col("subtree_length") >= F.col("_last")) & (F.col("radius").isNull() | off)
    quality = F.when(new, POLYNOMIAL).otherwise(F.col("quality")).cast(dict(cylinders.dtypes)["quality"])
    return t.withColumns({"radius": F.when(new, guess).otherwise(F.col("radius")), "quality": quality}).select(*cylinders.columns)


def failing_run(cylinders: DataFrame, most: int = 5) -> DataFrame:
    """Cylinders of each axis from base to tip up to the `most`-th in a row whose quality is below MEASURED."""
    w = Window.partitionBy("tree_id", "axis_ID").orderBy(F.desc("subtree_length"), "cyl_ID")
    low = F.col("quality") < MEASURED
    t = cylinders.withColumn("_i", F.row_number().over(w)).withColumn("_good", F.max(F.when(~low, F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("_run", F.col("_i") - F.coalesce("_good", F.lit(0)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("_stop", F.coalesce(F.max(F.when(low, F.col("_run"))).over(before) >= most, F.lit(False))).where("not _stop").select(*cylinders.columns)


def axis_map(cylinders: DataFrame) -> DataFrame:
    """Cylinders with `place`, from 1 at the base of each axis, by falling subtree length."""
    return cylinders.withColumn("place", F.row_number().over(Window.partitionBy("tree_id", "axis_ID").orderBy(F.desc("subtree_length"), "cyl_ID")))


def ordered(cylinders: DataFrame) -> DataFrame:
    """By tree, then by cylinder."""
    return cylinders.orderBy("tree_id", "cyl_ID")


def prolongation(points: DataFrame, cylinders: DataFrame) -> DataFrame:
    """The greatest height above ground among points not above the lowest start; (tree_id, prolong)."""
    low = cylinders.groupBy("tree_id").agg(F.min("startZ").alias("low"))
    return points.join(low, points["treeID"] == low["tree_id"]).where("Z <= low").groupBy("tree_id").agg(F.max("hag").alias("prolong"))


def shift(cylinders: DataFrame, tx: float, ty: float, tz: float) -> DataFrame:
    """Coordinates plus an offset."""
    by = {"X": tx, "Y": ty, "Z": tz}
    return cylinders.withColumns({f"{e}{a}": F.col(f"{e}{a}") + by[a] for e in ("start", "end") for a in "XYZ"})


def ring_frames(cylinders: DataFrame) -> DataFrame:
    """The cylinders that have length and radius, with two unit vectors (_u0, _u1, 0), (_v0, _v1, _v2) across their axes."""
    t = cylinders.where((length() > 1e-9) & (F.col("radius") > 1e-9))
    t = t.withColumns({f"_d{a}": F.col(f"end{a}") - F.col(f"start{a}") for a in "XYZ"})
    t = t.withColumns({"_flat": F.sqrt(F.col("_dX") * F.col("_dX") + F.col("_dY") * F.col("_dY")), "_n": length()})
    level = F.col("_flat") < 1e-9
    t = t.withColumns({"_u0": F.when(level, 1.0).otherwise(-F.col("_dY") / F.col("_flat")), "_u1": F.when(level, 0.0).otherwise(F.col("_dX") / F.col("_flat")), **{f"_w{i}": F.col(f"_d{a}") / F.col("_n") for i, a in enumerate("XYZ")}})
    u, w = [F.col("_u0"), F.col("_u1"), F.lit(0.0)], [F.col(f"_w{i}") for i in range(3)]
    v = [w[1] * u[2] - w[2] * u[1], w[2] * u[0] - w[0] * u[2], w[0] * u[1] - w[1] * u[0]]
    return t.select(*cylinders.columns, "_u0", "_u1", *[x.alias(f"_v{i}") for i, x in enumerate(v)])


def ring_place(end: Column, side: Column, sides: int) -> list[Column]:
    """(x, y, z) of a point of a ring of ring_frames()."""
    angle, u = side * (2 * F.pi() / sides), [F.col("_u0"), F.col("_u1"), F.lit(0.0)]
    return [F.when(end == 0, F.col(f"start{a}")).otherwise(F.col(f"end{a}")) + F.col("radius") * (F.cos(angle) * u[i] + F.sin(angle) * F.col(f"_v{i}")) for i, a in enumerate("XYZ")]


def ring_points(cylinders: DataFrame, sides: int = 12) -> DataFrame:
    """Rings of points around both ends of each cylinder that has length and radius."""
    t = ring_frames(cylinders).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))).withColumn("end", F.explode(F.array(F.lit(0), F.lit(1))))
    at = ring_place(F.col("end"), F.col("side"), sides)
    return t.select("tree_id", "cyl_ID", "end", "side", *[x.alias(a) for a, x in zip("xyz", at, strict=True)])


def ring_faces(sides: int = 12, split: bool = True) -> list[tuple[int, ...]]:
    """Faces between two rings of vertices 0..sides-1 and sides..2 sides-1, two triangles for each side."""
    out: list[tuple[int, ...]] = []
    for i in range(sides):
        j = (i + 1) % sides
        quad = (i, j, sides + j, sides + i)
        out += [(quad[0], quad[1], quad[2]), (quad[0], quad[2], quad[3])] if split else [quad]
    return out
