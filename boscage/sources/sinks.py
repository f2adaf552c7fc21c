"""Writers of tree models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.operators.mesh import tree_mesh
from boscage.operators.trees import ring_faces, ring_frames, ring_place
from boscage.schema import check_cylinders
from boscage.sources.files import prepare, save

#: The CSV's columns in order.
CSV_COLUMNS = ("startX", "startY", "startZ", "endX", "endY", "endZ", "cyl_ID", "parent_ID", "axis_ID", "branch_order", "dist_to_root", "subtree_length", "radius", "quality")


def csv_rows(cylinders: DataFrame) -> DataFrame:
    """K2: the CSV columns in order, numbers with three decimals, behind the tree_id that names the file; absent ones are null."""
    kinds = dict(cylinders.dtypes)
    none = lambda c: F.lit(None).cast("string").alias(c)
    return cylinders.select("tree_id", *[none(c) if c not in kinds else F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c))).alias(c) if kinds[c] == "double" else F.col(c) for c in CSV_COLUMNS])


def obj_lines(cylinders: DataFrame, sides: int = 12) -> DataFrame:
    """(tree_id, cyl_ID, kind, n, line): vertex and 1-based face lines, numbered within the tree."""
    rank = F.expr("dense_rank() over (partition by tree_id order by cyl_ID)") - 1
    # numbers go to cylinders before they become lines, so that lines are never sorted or shuffled
    c = ring_frames(cylinders).withColumn("base", rank * (2 * sides))
    corners = ring_faces(sides)
    c = c.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2 * sides + len(corners) - 1))))
    i, vertex = F.col("i"), F.col("i") < 2 * sides
    faces = F.array(*[F.struct(*[F.lit(k).alias(n) for k, n in zip(f, "abc", strict=True)]) for f in corners])
    f = F.get(faces, i - 2 * sides)
    at = [(F.col("base") + f[n] + 1).cast("long") for n in "abc"]
    line = F.when(vertex, F.format_string("v %.3f %.3f %.3f", *ring_place((i / sides).cast("int"), i % sides, sides))).otherwise(F.format_string("f %d %d %d", *at))
    n = F.when(vertex, F.col("base") + i + 1).otherwise(F.col("base") + i - 2 * sides).cast("long")
    return c.select("tree_id", "cyl_ID", F.when(vertex, "v").otherwise("f").alias("kind"), n.alias("n"), line.alias("line"))


def face_normals(faces: DataFrame) -> DataFrame:
    """K5: unit normals (nx, ny, nz) of triangles (ax..cz); zero for degenerate ones."""
    u = [F.col(f"b{a}") - F.col(f"a{a}") for a in "xyz"]
    v = [F.col(f"c{a}") - F.col(f"a{a}") for a in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] ** 2 + n[1] ** 2 + n[2] ** 2)
    return faces.withColumns({f"n{a}": F.when(size > 0, x / size).otherwise(0.0) for a, x in zip("xyz", n, strict=True)})


def raster_quads(raster: DataFrame) -> DataFrame:
    """K9: (row, col) of cells whose three lower-right neighbours have a value as well; raster is (row, col, z)."""
    have = raster.where("z is not null").select("row", "col")
    out = have
    for dr, dc in ((1, 0), (0, 1), (1, 1)):
        out = out.join(have.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col")), ["row", "col"], "left_semi")
    return out


def _normals(corners: np.ndarray) -> np.ndarray:
    n = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    size = np.linalg.norm(n, axis=1, keepdims=True)
    return np.where(size > 0, n / np.where(size > 0, size, 1), 0.0)


def ply(v: np.ndarray, f: np.ndarray, binary: bool = False) -> bytes:
    """K3: a mesh of triangles; text has three decimals, binary is little-endian doubles."""
    kind = "binary_little_endian" if binary else "ascii"
    head = f"ply\nformat {kind} 1.0\nelement vertex {len(v)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(f)}\nproperty list uchar int vertex_indices\nend_header\n".encode()
    if binary:
        rows = np.zeros(len(f), [("n", "u1"), ("at", "<i4", 3)])
        rows["n"], rows["at"] = 3, f
        return head + v.astype("<f8").tobytes() + rows.tobytes()
    return head + "".join([*("%.3f %.3f %.3f\n" % tuple(x) for x in v), *("3 %d %d %d\n" % tuple(x) for x in f)]).encode()


def stl(v: np.ndarray, f: np.ndarray, origin: np.ndarray, binary: bool = False) -> bytes:
    """K5: the triangles with their normals, less `origin`, as the format's single precision holds no map coordinates."""
    corners = v[f]
    normal, corners = _normals(corners), corners - origin
    if binary:
        rows = np.zeros(len(f), [("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])
        rows["normal"], rows["corners"] = normal, corners
        return b"QSM binary STL".ljust(80, b"\0") + len(f).to_bytes(4, "little") + rows.tobytes()
    one = "  facet normal %g %g %g\n    outer loop\n" + "      vertex %g %g %g\n" * 3 + "    endloop\n  endfacet\n"
    return ("solid QSM\n" + "".join(one % tuple(x) for x in np.hstack([normal, corners.reshape(-1, 9)])) + "endsolid QSM\n").encode()


def root_place(t: pd.DataFrame) -> np.ndarray:
    """Where a tree starts: the start of its first cylinder without a parent in it."""
    top = t[~t["parent_ID"].isin(t["cyl_ID"])].sort_values(["parent_ID", "cyl_ID"])
    return (top if len(top) else t)[["startX", "startY", "startZ"]].to_numpy(float)[0]


def _write_meshes(cylinders: DataFrame, path: str, kind: str, mode: str, binary: bool, sides: int) -> None:
    """One file a tree, tree_id=<id>/model.<kind>, written by the task that meshed it."""
    prepare(path, mode)

    def run(key, t: pd.DataFrame) -> pd.DataFrame:
        v, f = tree_mesh(t, sides)
        save(f"{path.rstrip('/')}/tree_id={key[0]}/model.{kind}", ply(v, f, binary) if kind == "ply" else stl(v, f, root_place(t), binary))
        return pd.DataFrame({"tree_id": [key[0]]})

    need = ["cyl_ID", "parent_ID", "axis_ID", *[f"{e}{a}" for e in ("start", "end") for a in "XYZ"], "radius"]
    made = cylinders.select(F.col("tree_id").cast("long").alias("tree_id"), *need).groupBy("tree_id").applyInPandas(run, "tree_id long")
    made.write.format("noop").mode("overwrite").save()


def model_roots(cylinders: DataFrame, crs: str = "", software: str = "boscage") -> DataFrame:
    """K6: (tree_id, name, software, format, crs, originX, originY, originZ): a row a tree, its origin the start of its root."""
    c = cylinders.alias("c")
    up = cylinders.select(F.col("tree_id").alias("_t"), F.col("cyl_ID").alias("_p"))
    top = c.join(up, (F.col("c.tree_id") == F.col("_t")) & (F.col("c.parent_ID") == F.col("_p")), "left_anti")
    first = F.struct("parent_ID", "cyl_ID")
    return top.groupBy("tree_id").agg(*[F.min_by(f"start{a}", first).alias(f"origin{a}") for a in "XYZ"]).select("tree_id", F.concat(F.lit("tree_"), F.col("tree_id").cast("string")).alias("name"), F.lit(software).alias("software"), F.lit(2).alias("format"), F.lit(crs).alias("crs"), "originX", "originY", "originZ")


def write(cylinders: DataFrame, path: str, kind: str = "parquet", mode: str = "error", binary: bool = False, sides: int = 12, crs: str = "") -> None:
    """K1, K3, K5 to K8: one folder a tree; kinds: parquet, csv, txt, obj, ply, stl (`binary` for the latter two), and qsm:
    cylinders and a table of the trees, both Parquet."""
    check_cylinders(cylinders)
    if kind == "parquet":
        cylinders.write.partitionBy("tree_id").mode(mode).parquet(path)
    elif kind == "qsm":
        cylinders.write.partitionBy("tree_id").mode(mode).parquet(f"{path}/cylinders")
        model_roots(cylinders, crs).write.mode(mode).parquet(f"{path}/trees")
    elif kind in ("csv", "txt"):
        csv_rows(cylinders).repartition("tree_id").sortWithinPartitions("tree_id", "cyl_ID").write.partitionBy("tree_id").mode(mode).option("header", True).csv(path)
    elif kind == "obj":
        lines = obj_lines(cylinders).repartition("tree_id").sortWithinPartitions("tree_id", F.desc("kind"), "n", "cyl_ID")
        lines.select("tree_id", "line").write.partitionBy("tree_id").mode(mode).text(path)
    elif kind in ("ply", "stl"):
        _write_meshes(cylinders, path, kind, mode, binary, sides)
    else:
        raise ValueError(f"no writer for {kind}")
