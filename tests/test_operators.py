"""Invariants and brute-force comparisons of the library's operators."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boscage.functions import geometry as G
from boscage.operators import fitting, graph, points, spatial, trees
from boscage.params import Params, PathFinder
from boscage.schema import check_cylinders, check_points
from boscage.sources import sinks


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(5)
    rows = [(i, rng.random() * 3, rng.random() * 3, rng.random() * 3) for i in range(150)]
    return rows, spark.createDataFrame(rows, "point_id long, X double, Y double, Z double")


def _d2(a, b):
    return sum((x - y) ** 2 for x, y in zip(a[1:], b[1:], strict=True))


def test_knn_is_exact(cloud):
    rows, df = cloud
    got = {}
    for r in spatial.knn_join(df, df, 5).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["point_id"]))
    for a in rows:
        want = [b[0] for b in sorted(rows, key=lambda b: (_d2(a, b), b[0]))[:5]]
        assert [p for _, p in sorted(got[a[0]])] == want


def test_knn_with_too_few_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 9.0, 0.0, 0.0)], "point_id long, X double, Y double, Z double")
    assert spatial.knn_join(df, df, 5).count() == 4


def test_radius_join_is_symmetric_and_exact(cloud):
    rows, df = cloud
    got = {(r["qid"], r["point_id"]) for r in spatial.radius_join(df, df, 0.6).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if _d2(a, b) < 0.36}


def test_one_point_a_voxel(cloud):
    _, df = cloud
    kept = points.homogenise(df, 0.5)
    assert kept.count() == points.voxel_occupancy(df, 0.5).count() == points.with_voxels(df, 0.5).select("vx", "vy", "vz").distinct().count()


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    parent = list(range(80))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = graph.components(spark.range(80).select(F.col("id").alias("node")), spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {i: find(i) for i in range(80)}


def test_shortest_paths_against_a_heap(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40), rng.random()) for _ in range(120)]
    dist, todo = {0: 0.0}, [(0.0, 0)]
    while todo:
        d, u = heapq.heappop(todo)
        for a, b, c in edges:
            if a == u and d + c < dist.get(b, math.inf):
                dist[b] = d + c
                heapq.heappush(todo, (d + c, b))
    got = graph.shortest_paths(spark.createDataFrame(edges, "src long, dst long, cost double"), spark.range(1).select(F.col("id").alias("node")))
    assert {r["node"]: pytest.approx(r["dist"]) for r in got.collect()} == dist
    assert {r["node"] for r in graph.reachable(spark.createDataFrame(edges, "src long, dst long, cost double"), spark.range(1).select(F.col("id").alias("node"))).collect()} == set(dist)


@pytest.fixture(scope="module")
def tree(spark):
    """A trunk of six cylinders with a side branch of two at the third."""
    rows = [(1, i, i - 1, 0.0, 0.0, i - 1.0, 0.0, 0.0, float(i), 0.2 - 0.02 * i) for i in range(1, 7)]
    rows += [(1, 7, 3, 0.0, 0.0, 3.0, 1.0, 0.0, 3.5, 0.05), (1, 8, 7, 1.0, 0.0, 3.5, 2.0, 0.0, 4.0, 0.02)]
    return spark.createDataFrame(rows, "tree_id long, cyl_ID long, parent_ID long, startX double, startY double, startZ double, endX double, endY double, endZ double, radius double")


def test_tree_folds(tree):
    t = {r["cyl_ID"]: r for r in trees.subtree(trees.dist_to_root(tree)).collect()}
    assert t[1]["dist_to_root"] == pytest.approx(0) and t[8]["dist_to_root"] == pytest.approx(3 + math.hypot(1, 0.5))
    assert t[1]["subtree_length"] == pytest.approx(5) and t[6]["subtree_length"] == pytest.approx(0)
    a = {r["cyl_ID"]: (r["branch_order"], r["axis"]) for r in trees.architecture(tree).collect()}
    assert a[6] == (1, 1) and a[7] == (2, 7) and a[8] == (2, 7)


def test_dbh_between_starts(tree):
    trunk = trees.dist_to_root(tree.where("cyl_ID <= 6")).withColumn("branch_order", F.lit(1))
    r = trees.dbh(trunk).first()
    assert r["dbh"] == pytest.approx(2 * (0.16 + 0.3 * (0.16 - 0.18) + 0.0)) and r["z"] == pytest.approx(1.3)


def test_validate_finds_two_roots(spark, tree):
    loose = tree.unionByName(spark.createDataFrame([(1, 20, 15) + (0.0,) * 7], tree.schema))
    assert trees.validate(tree).first()["valid"] and not trees.validate(loose).first()["valid"]


def test_merchantable_keeps_paths_to_thick_wood(tree):
    a = trees.architecture(tree)
    assert {r["cyl_ID"] for r in trees.merchantable(a, 0.045, 1.0).collect()} == {1, 2, 3, 4, 5, 6, 7}


def test_writers(tree, tmp_path, spark):
    sinks.write(tree, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 8
    sinks.write(tree, str(tmp_path / "obj"), "obj")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "obj")).select("value").collect()]
    assert sum(x.startswith("v ") for x in lines) == 8 * 24 and sum(x.startswith("f ") for x in lines) == 8 * 24
    with pytest.raises(ValueError):
        sinks.write(tree, str(tmp_path / "x"), "stl2")


def test_contracts(spark, tree):
    with pytest.raises(ValueError):
        check_points(spark.range(1))
    with pytest.raises(TypeError):
        check_points(spark.sql("select 1.0d X, 1.0d Y, 1.0d Z, 'a' name"))
    with pytest.raises(ValueError):
        check_cylinders(tree.drop("endX"))
    with pytest.raises(ValueError):
        PathFinder(penalty=(1.0,))
    with pytest.raises(KeyError):
        Params.of({"qsm": {}})
    with pytest.raises(ValueError):
        points.sor(tree, 2, 1)
    with pytest.raises(ValueError):
        points.voxel_components(tree, 1, 7)


def test_rotation_takes_the_axis_up():
    for axis in ((0, 0, 1), (0, 0, -1), (0, -1, 1), (1, 2, 3)):
        m = np.array(G.rotation_to_z(axis))
        up = m @ (np.array(axis) / np.linalg.norm(axis))
        assert np.allclose(up, [0, 0, 1]) and np.allclose(m @ m.T, np.eye(3)) and np.isclose(np.linalg.det(m), 1)


def _shape(x, y, half=False):
    rng = np.random.default_rng(3)
    t = np.linspace(0, np.pi if half else 2 * np.pi, 500)
    return np.c_[12 + x(t) + rng.normal(0, 0.1, 500), 18.5 + y(t) + rng.normal(0, 0.1, 500), rng.uniform(0, 2, 500)]


def test_circle():
    f = fitting.fit(_shape(lambda t: 2 * np.cos(t), lambda t: 2 * np.sin(t)), 0.15)
    assert f.shape_type == "circle" and f.radius == pytest.approx(2, rel=0.025) and f.center[:2] == pytest.approx((12, 18.5), rel=0.005) and f.arc_deg == 360


def test_half_circle():
    f = fitting.fit(_shape(lambda t: 2 * np.cos(t), lambda t: 2 * np.sin(t), True), 0.1)
    assert f.shape_type == "circle" and f.radius == pytest.approx(2, rel=0.05) and f.arc_deg == pytest.approx(190, abs=20)


def test_ellipse():
    f = fitting.fit(_shape(lambda t: 4 * np.cos(t), lambda t: 1.5 * np.sin(t)), 0.15)
    assert f.shape_type == "ellipse" and f.radius == pytest.approx(6**0.5, rel=0.05) and f.arc_deg == 360


def test_circloid():
    rng = np.random.default_rng(9)
    t = np.linspace(0, 2 * np.pi, 500)
    r = 3 + 0.5 * np.cos(t) + np.sin(2 * t) + rng.uniform(-0.25, 0.25, 500)
    f = fitting.fit(np.c_[12 + r * np.cos(t), 18.5 + r * np.sin(t), rng.uniform(0, 2, 500)], 0.15)
    assert f.shape_type == "fourier5" and f.radius == pytest.approx(3.1, rel=0.05)


def test_passages_count_paths(spark):
    from boscage.plans.queries import passages

    got = passages(spark, "/root/testdata/sf0.001").agg(F.max("passage"), F.count("*")).first()
    assert got[0] == got[1]  # every path starts at the source


def test_drop_butt_removes_orphans(spark):
    rows = []
    for tree, bent in ((1, 2), (2, 0), (3, 9)):  # 3: no straight run
        x = z = 0.0
        for i in range(1, 10):
            a, b = (x, z), (x + (1.0 if i <= bent else 0.0), z + (0.1 if i <= bent else 1.0))
            rows.append((tree, i, i - 1, a[0], 0.0, a[1], b[0], 0.0, b[1], 0.1, 1, float(i)))
            x, z = b
        for i, parent in ((11, 1), (12, 11), (13, 2), (14, 5), (15, 14)):
            rows.append((tree, i, parent, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.1, 2, 20.0))
    rows.append((2, 20, 99, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.1, 2, 20.0))  # another root
    t = spark.createDataFrame(rows, "tree_id long, cyl_ID long, parent_ID long, startX double, startY double, startZ double, endX double, endY double, endZ double, radius double, branch_order int, dist_to_root double")
    got = trees.drop_butt(t)
    assert got.columns == t.columns
    kept = {(r["tree_id"], r["cyl_ID"]): r["parent_ID"] for r in got.collect()}
    want = {(r[0], r[1]): r[2] for r in rows if r[0] != 1 or r[1] in (3, 4, 5, 6, 7, 8, 9, 14, 15)}
    want[1, 3] = 0
    assert kept == want
