"""Meshes, file formats and the command line."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boscage import __main__ as command
from boscage.operators import mesh
from boscage.operators._state import cut
from boscage.sources import las, sinks, tables
from tests.scene import forest

MODEL = "tree_id long, cyl_ID long, parent_ID long, axis_ID long, branch_order int, dist_to_root double, subtree_length double, startX double, startY double, startZ double, endX double, endY double, endZ double, radius double"


@pytest.fixture(scope="module")
def model(spark):
    """A trunk with a bend, a branch of two cylinders and a second tree of one cylinder far from the origin."""
    rows = [(1, 1, 0, 1, 1, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.3), (1, 2, 1, 1, 1, 1.0, 2.0, 0.0, 0.0, 1.0, 1.0, 0.0, 2.0, 0.2), (1, 3, 2, 1, 1, 2.4, 1.0, 1.0, 0.0, 2.0, 1.0, 0.0, 3.0, 0.1)]
    rows += [(1, 4, 2, 2, 2, 2.4, 1.0, 1.0, 0.0, 2.0, 2.0, 1.0, 2.0, 0.05), (1, 5, 4, 2, 2, 3.8, 0.5, 2.0, 1.0, 2.0, 3.0, 1.0, 1.5, None), (2, 1, 0, 1, 1, 0.0, 1.0, 5e5, 4e6, 10.0, 5e5, 4e6, 11.0, 0.1)]
    return spark.createDataFrame(rows, MODEL)


def test_tubes(model):
    ring = mesh.rings(model).orderBy("tree_id", "ring").toPandas()
    assert ring[ring.tree_id == 1][["axis_ID", "place", "cyl_ID", "ring"]].to_numpy().tolist() == [[1, 0, 1, 0], [1, 1, 1, 1], [1, 2, 2, 2], [1, 3, 3, 3], [2, 0, 4, 4]]
    assert np.allclose(ring[ring.tree_id == 1].r, [0.3, 0.25, 0.15, 0.1, 0.05]) and ring[ring.tree_id == 1].next.fillna(-1).tolist() == [1, 2, 3, -1, -1]
    u, v = ring[["ux", "uy", "uz"]].to_numpy(), ring[["vx", "vy", "vz"]].to_numpy()
    assert np.allclose((u * u).sum(1), 1) and np.allclose((v * v).sum(1), 1) and np.allclose((u * v).sum(1), 0)
    own = mesh.vertices(mesh.rings(model), 8).where("tree_id = 1").orderBy("n").toPandas()
    t = model.where("tree_id = 1").toPandas()
    vertices, triangles = mesh.tree_mesh(t, 8)
    assert np.allclose(own[["x", "y", "z"]], vertices) and own.n.tolist() == list(range(40))
    faces = mesh.faces(mesh.rings(model), 8).where("tree_id = 1").toPandas()[["a", "b", "c"]].to_numpy()
    assert sorted(map(tuple, faces)) == sorted(map(tuple, triangles.tolist())) and len(faces) == 3 * 8 * 2
    assert mesh.faces(mesh.rings(model), 8, split=False).where("tree_id = 1").count() == 3 * 8
    assert mesh.rings(model.where("false")).count() == 0


def test_frames_turn_without_twist():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (x / np.linalg.norm(x) for x in rng.normal(size=(2, 3)))
        u, v = mesh.frame(a)
        p, q = mesh.transported(u, v, a, b)
        axis, angle = np.cross(a, b), np.arccos(a @ b)
        axis /= np.linalg.norm(axis)
        turned = u * np.cos(angle) + np.cross(axis, u) * np.sin(angle) + axis * (axis @ u) * (1 - np.cos(angle))
        assert np.allclose(p, turned) and np.allclose(q, np.cross(b, p)) and np.allclose(np.cross(u, v), a)
    u, v = mesh.frame(np.array([0.0, 0.0, 1.0]))
    assert u.tolist() == [1, 0, 0] and mesh.transported(u, v, np.array([0.0, 0, 1]), np.array([0.0, 0, -1]))[1].tolist() == (-v).tolist()
    assert np.isfinite(mesh.frame(np.array([0.0, 0.0, -1.0]))).all()


def test_mesh_files(spark, model, tmp_path):
    for kind in ("ply", "stl"):
        for binary in (False, True):
            sinks.write(model, f"{tmp_path}/{kind}{binary}", kind, binary=binary)
    with pytest.raises(ValueError, match="exists"):
        sinks.write(model, f"{tmp_path}/plyTrue", "ply")
    v, f = mesh.tree_mesh(model.where("tree_id = 2").toPandas())
    raw = (tmp_path / "plyTrue/tree_id=2/model.ply").read_bytes()
    head, body = raw[: raw.index(b"end_header\n") + 11], raw[raw.index(b"end_header\n") + 11 :]
    assert b"element vertex 24\n" in head and b"element face 24\n" in head
    assert np.array_equal(np.frombuffer(body, "<f8", 72).reshape(24, 3), v) and len(body) == 24 * 24 + 24 * 13 and body[576] == 3
    text = (tmp_path / "plyFalse/tree_id=2/model.ply").read_text().splitlines()
    assert text[1] == "format ascii 1.0" and text[9].split() == [f"{x:.3f}" for x in v[0]] and text[-1].split() == ["3", *map(str, f[-1])]
    raw = (tmp_path / "stlTrue/tree_id=2/model.stl").read_bytes()
    assert len(raw) == 84 + 50 * 24 and struct.unpack_from("<I", raw, 80)[0] == 24
    first = np.array(struct.unpack_from("<12f", raw, 84)).reshape(4, 3)
    assert np.allclose(first[1:], (v - [5e5, 4e6, 10.0])[f[0]], atol=1e-6) and abs(np.linalg.norm(first[0]) - 1) < 1e-6 and abs(first[0, 2]) < 1e-6
    text = (tmp_path / "stlFalse/tree_id=1/model.stl").read_text()
    assert text.startswith("solid QSM\n  facet normal ") and text.endswith("endsolid QSM\n") and text.count("endfacet") == 3 * 24


def test_models_round_trip(spark, model, tmp_path):
    sinks.write(model, str(tmp_path / "m"), "qsm", crs="EPSG:2949")
    cylinders, trees = tables.read_models(spark, str(tmp_path / "m"))
    key = lambda df: sorted(map(tuple, df.select(*model.columns).collect()), key=str)
    assert key(cylinders) == key(model)
    assert {tuple(r) for r in trees.select("tree_id", "name", "format", "crs", "originX", "originZ").collect()} == {(1, "tree_1", 2, "EPSG:2949", 0.0, 0.0), (2, "tree_2", 2, "EPSG:2949", 5e5, 10.0)}


def test_skeleton_ply(spark, tmp_path):
    v = np.arange(16, dtype="<f4").reshape(4, 4)
    lines = [[0, 1], [1, 2, 3], [2], [3, 9]]
    body = b"".join(np.array([len(x), *x], "<i4").tobytes() for x in lines)
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 4\nproperty float x\nelement edge 4\nproperty list uint int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_bytes(head + v.tobytes() + body)
    t = tables.read_skeleton_ply(spark, str(tmp_path / "a.ply")).orderBy("cyl_ID").toPandas()
    assert t[["parent_ID", "cyl_ID"]].to_numpy().tolist() == [[0, 1], [1, 2], [2, 3]]
    assert t.iloc[1][["startX", "startZ", "radius1", "endY", "radius2"]].tolist() == [4, 6, 7, 9, 11]
    with pytest.raises(ValueError, match="ends"):
        tables.skeleton_edges(head + v.tobytes() + body[:-4])
    assert not len(tables.skeleton_edges(head.replace(b"vertex 4", b"vertex 0").replace(b"edge 4", b"edge 0")))


def old_las(path, n=1000):
    """A version 1.2 file of point format 3 by hand; returns X."""
    dtype = np.dtype(las.FORMATS[3])
    raw = np.zeros(n, dtype)
    raw["X"], raw["flags"], raw["class"], raw["R"], raw["gpstime"] = np.arange(n), 0b010_001 | 0b1000000, 2 | 64, 65535, np.arange(n) / 7
    h = bytearray(227)
    struct.pack_into("<4s", h, 0, b"LASF")
    struct.pack_into("<BB", h, 24, 1, 2)
    struct.pack_into("<HII", h, 94, 227, 229, 0)
    struct.pack_into("<BHI", h, 104, 3, dtype.itemsize + 2, n)
    struct.pack_into("<6d", h, 131, 0.01, 0.01, 0.01, 100.0, 0.0, 0.0)
    wide = np.zeros(n, [("p", dtype), ("rest", "V2")])
    wide["p"] = raw
    path.write_bytes(bytes(h) + b"\0\0" + wide.tobytes())
    return raw["X"] * 0.01 + 100


def test_las(spark, tmp_path):
    x = old_las(tmp_path / "old.las")
    las.register(spark)
    t = spark.read.format("las").option("rows", 300).load(str(tmp_path / "old.las"))
    got = t.orderBy("X").toPandas()
    assert t.rdd.getNumPartitions() == 4 and np.allclose(got.X, x) and np.allclose(got.gpstime, np.arange(1000) / 7)
    assert set(got.Classification) == {2} and set(got.ReturnNumber) == {1} and set(got.NumberOfReturns) == {2} and set(got.R) == {65535}
    some = tables.read_points(spark, str(tmp_path / "old.las"), "X,gpstime", 0.5, 3)
    assert some.columns == ["X", "gpstime", "point_id"] and 400 < some.count() < 600 and some.count() == some.count()
    with pytest.raises(Exception, match="no hag"):
        tables.read_points(spark, str(tmp_path / "old.las"), "X,hag").count()
    raw = bytearray((tmp_path / "old.las").read_bytes())
    raw[104] |= 128
    (tmp_path / "bad.las").write_bytes(raw)
    with pytest.raises(ValueError, match="LAZ"):
        las.header(str(tmp_path / "bad.las"))


def test_las_round_trip(spark, tmp_path):
    n = 5000
    t = spark.range(0, n, 1, 3).select((F.col("id") * 0.25 + 684000).alias("X"), (-F.col("id") * 0.5).alias("Y"), (F.col("id") % 40).cast("double").alias("Z"), (F.col("id") % 9).cast("int").alias("treeID"), F.when(F.col("id") % 2 == 0, F.col("id") * 0.1).alias("hag"), F.lit(2).alias("Classification"), (F.col("id") % 3).cast("int").alias("UserData"), (F.col("id") * 1.0).alias("gpstime"))
    las.register(spark)
    for mode in ("overwrite", "append"):
        t.write.format("las").option("maxRecordsPerFile", 1000).mode(mode).save(str(tmp_path / "cloud.las"))
    assert len(list((tmp_path / "cloud.las").glob("part-*.las"))) == 12 and not list((tmp_path / "cloud.las").glob(".draft*"))
    back = spark.read.format("las").load(str(tmp_path / "cloud.las"))
    got = back.dropDuplicates().orderBy("gpstime").toPandas()
    want = t.orderBy("gpstime").toPandas()
    assert back.count() == 2 * n and len(got) == n
    for c in want.columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1e-3, equal_nan=True), c
    with pytest.raises(Exception, match="coordinates"):
        t.withColumn("X", F.when(F.col("hag").isNotNull(), F.col("X"))).write.format("las").mode("overwrite").save(str(tmp_path / "none.las"))
    assert not list((tmp_path / "none.las").glob("part-*"))


def test_models_and_report_by_command(spark, tmp_path):
    f = forest(((2.0, 2.0, 5.0, 0.15), (5.0, 4.0, 4.5, 0.12)), side=0.2, dense=0.6)
    f = f[f.truth > 0].assign(hag=f.hag_true, foliage=(f.part != "wood").astype(int), treeID=f.truth, UserData=0)
    spark.createDataFrame(f[["point_id", "X", "Y", "Z", "hag", "foliage", "treeID", "UserData"]]).write.parquet(str(tmp_path / "trees.parquet"))
    where = command.main(["qsf", str(tmp_path / "trees.parquet"), "-o", str(tmp_path / "qsm"), "-qsm", "-ply", "-csv"], spark)
    cylinders, trees = tables.read_models(spark, f"{where}/qsm")
    assert cylinders.where("radius is not null").count() > 20 and trees.count() == 2
    assert len(list((tmp_path / "qsm/ply").glob("tree_id=*/model.ply"))) == 2 and spark.read.option("header", True).csv(f"{where}/csv").count() == cylinders.count()
    made = command.main(["report", f"{where}/qsm"], spark)
    assert spark.read.parquet(f"{made}/forest").first()["n"] == 2 and spark.read.parquet(f"{made}/trees").where("H > 4").count() == 2
    with pytest.raises(SystemExit):
        command.main(["segment"], spark)


def test_prepared(spark):
    t = spark.range(2000).select(F.col("id").alias("point_id"), (F.col("id") * 0.01 + 500).alias("X"), (F.col("id") % 10 * 0.3).alias("Y"), F.lit(7.0).alias("Z"))
    got = command.prepared(t, True).agg(F.count("*").alias("n"), F.avg("X").alias("x"), F.min("Z").alias("z")).first()
    assert 0 < got["n"] <= 2000 and abs(got["x"]) < 1 and got["z"] == 0


def test_loops_keep_their_plans_small(spark):
    t = spark.range(100).withColumn("v", F.col("id") % 7)
    for _ in range(12):
        t = cut(t.join(t.groupBy("id").agg(F.max("v").alias("w")), "id").select("id", F.greatest("v", "w").alias("v")))
    assert int(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < 70 and t.count() == 100
    assert t.agg(F.sum("v")).first()[0] == sum(i % 7 for i in range(100))
    assert t.groupBy("id").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1


def test_hull(spark):
    p = pd.DataFrame(np.random.default_rng(2).normal(size=(3000, 2)), columns=["X", "Y"])
    got = command.hull_of(spark.createDataFrame(p).repartition(5))
    assert sorted(got) == sorted(command.P.convex_hull(list(zip(p.X, p.Y, strict=True))))
