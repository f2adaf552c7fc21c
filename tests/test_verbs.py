"""The public verbs on a made forest whose truth is known, graph repairs against plain code, models of trees."""

import heapq

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boscage.functions import geometry as G
from boscage.operators import fitting, graph, ground, points, qsm, routes, trees, verbs
from boscage.params import Params, PathFinder, Qsm, Semantic
from tests.scene import forest


@pytest.fixture(scope="module")
def scene():
    return forest(((2.0, 2.0, 5.0, 0.15), (4.0, 3.5, 5.0, 0.14)), side=6.0, dense=0.5)


@pytest.fixture(scope="module")
def cloud(spark, scene):
    return spark.createDataFrame(scene).repartition(4, "point_id").cache()


def test_ground_and_heights(cloud, scene):
    got = ground.segment_ground(cloud.select("point_id", "X", "Y", "Z"), 3.0, 2.0).toPandas().merge(scene, on="point_id")
    assert len(got) == len(scene) and (got.Classification == 2)[got.part == "ground"].mean() > 0.98
    assert (got.Classification == 2)[(got.part != "ground") & (got.hag_true > 0.3)].mean() == 0
    assert np.abs(got.hag - got.hag_true)[got.hag_true > 0.3].max() < 0.06
    t = ground.dtm(ground.segment_ground(cloud.select("point_id", "X", "Y", "Z")), 0.5).toPandas()
    assert np.abs(t.z - (0.02 * t.x + 0.01 * t.y)).max() < 0.1 and len(t) == 144
    assert ground.segment_ground(cloud.select("point_id", "X", "Y", "Z").where("false")).count() == 0
    more = ground.single_tree_ground(cloud.select("point_id", "X", "Y", "Z"), 50)
    assert more.count() == len(scene) + 50 and more.where("Classification = 2").count() == 50


def _cloud_of_chains(spark):
    rng = np.random.default_rng(1)
    line = np.c_[np.zeros(30), np.zeros(30), np.arange(30) * 0.1]
    apart = np.c_[np.full(20, 2.0), np.zeros(20), np.arange(20) * 0.1 + 1]
    x = np.concatenate([line, apart]) + rng.normal(0, 0.002, (50, 3))
    return x, spark.createDataFrame(pd.DataFrame({"point_id": range(50), "X": x[:, 0], "Y": x[:, 1], "Z": x[:, 2]}))


def test_distance_to_root_bridges_clusters(spark):
    x, df = _cloud_of_chains(spark)
    got = routes.dist2root(df, df.where("point_id = 0"), 6, 0.5, 2.0).toPandas().sort_values("point_id").dist2root.to_numpy()
    assert got[0] == 0 and abs(got[29] - 2.9) < 0.1 and (got >= 0).all()
    gap = np.sqrt(((x[30:, None] - x[None, :30]) ** 2).sum(2)).min()
    assert got[30:].min() > 1.0 + gap - 0.2
    way = qsm.lengths_to_root(x, np.arange(50) == 0, 6, 0.5, 2.0)
    assert np.abs(way[:30] - got[:30]).max() < 0.11 and (way >= 0).all()  # the first step from a seed counts nothing there


def test_paths_and_passages(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.random(300), strict=True)]
    df = spark.createDataFrame(edges, "src long, dst long, cost double")
    best = graph.shortest_paths(df, spark.range(1).select(F.col("id").alias("node"))).cache()
    out = {}
    for a, b, c in edges:
        out.setdefault(a, []).append((b, c))
    dist, todo = {}, [(0.0, 0, None)]
    pred = {}
    while todo:
        d, n, p = heapq.heappop(todo)
        if n not in dist:
            dist[n], pred[n] = d, p
            for m, c in out.get(n, []):
                heapq.heappush(todo, (d + c, m, n))
    got = {r["node"]: r["dist"] for r in best.collect()}
    assert got.keys() == dist.keys() and all(abs(got[k] - dist[k]) < 1e-9 for k in dist)
    goals = [5, 17, 1000]
    found = graph.find_paths(best, spark.createDataFrame([(g,) for g in goals], "node long")).collect()
    for g in goals:
        path, n = [], g if g in dist else None
        while n is not None:
            path.append(n)
            n = pred[n]
        assert [r["node"] for r in sorted((r for r in found if r["goal"] == g), key=lambda r: r["step"])] == path
    count = dict.fromkeys(dist, 0)
    for t in (3, 5, 17):
        n = t if t in dist else None
        while n is not None:
            count[n] += 1
            n = pred[n]
    targets = spark.createDataFrame([(3,), (5,), (17,)], "node long")
    assert {r["node"]: r["passage"] for r in graph.passages(best, targets).collect()} == count


def test_cycles_are_errors(spark):
    ring = spark.createDataFrame([(1, None), (2, 3), (3, 2)], "node long, parent long")
    with pytest.raises(ValueError):
        graph.ancestors(ring, [], {"n": F.lit(1)}, False)


def test_seeds_and_trees(spark, cloud, scene):
    truth = cloud.select("point_id", "X", "Y", "Z", F.col("hag_true").alias("hag"), F.when(F.col("part") == "wood", 0).otherwise(1).alias("foliage"), F.when(F.col("part") == "wood", 20).otherwise(0).alias("passage")).where("part <> 'ground' and hag_true > 0.26").cache()
    p = Params(path_finder=PathFinder(k_seed_connectivity=20))
    seeds = verbs.find_seeds(truth, p).cache()
    low = seeds.toPandas().merge(scene[["point_id", "truth"]], on="point_id")
    assert set(low.truth) == {1, 2} and (low.groupby("treeID").truth.nunique() == 1).all()
    got = verbs.segment_instance(truth, seeds, p).toPandas().merge(scene[["point_id", "truth"]], on="point_id")
    name = low.groupby("treeID").truth.first()
    assert got.treeID.notna().mean() > 0.95 and (got.treeID.map(name) == got.truth)[got.treeID.notna()].mean() > 0.95
    with pytest.raises(ValueError):
        verbs.segment_instance(truth.drop("foliage"), seeds, p)


def test_wood_and_leaf(spark, scene):
    part = scene[(scene.truth == 1) & (scene.hag_true < 3.2) | (scene.truth == 0) & (scene.X < 3) & (scene.Y < 3)]
    df = spark.createDataFrame(part.assign(hag=part.hag_true, Classification=np.where(part.part == "ground", 2, 1), pwood=np.where(part.part == "wood", 0.95, 0.3))).select("point_id", "X", "Y", "Z", "hag", "Classification", "pwood")
    p = Params(semantic=Semantic(cc_min=50, cc_res=0.1), path_finder=PathFinder(decimation=0.1, k_seed_connectivity=20))
    got = verbs.segment_semantic(df, p).toPandas().merge(scene[["point_id", "part", "hag_true"]], on="point_id")
    assert len(got) == len(part)
    high = got[got.hag_true > 0.3]
    assert (high.foliage == 0)[high.part == "wood"].mean() > 0.9 and (high.foliage == 0)[high.part == "leaf"].mean() < 0.2
    assert (got.UserData == 1)[got.hag_true < 0.2].all() and got.passage.max() > 10


def test_models(spark, scene):
    f = forest(((0.0, 0.0, 8.0, 0.15), (5.0, 0.0, 0.9, 0.02)), side=0.2)
    f = f[f.truth > 0]
    df = spark.createDataFrame(f.assign(treeID=f.truth, hag=f.hag_true, foliage=(f.part != "wood").astype(int), UserData=0)).select("point_id", "X", "Y", "Z", "hag", "foliage", "treeID", "UserData")
    t = qsm.qsf(df, 2).toPandas()
    assert set(t.tree_id) == {1} and t.cyl_ID.is_unique and t.radius.notna().all() and t.message.notna().sum() <= 1
    own = trees.validate(spark.createDataFrame(t.astype({"cyl_ID": "int64", "parent_ID": "int64", "tree_id": "int64"})[["tree_id", "cyl_ID", "parent_ID", *(f"{e}{a}" for e in ("start", "end") for a in "XYZ"), "radius"]])).first()
    assert own["valid"] and own["n"] == len(t)
    trunk = t[t.axis_ID == 1].sort_values("dist_to_root")
    at = trunk.radius.iloc[(trunk.dist_to_root - 1.3).abs().argmin()]
    assert abs(at - (0.15 - 0.13 * 1.3 / 8)) < 0.03 and abs(t.endZ.max() - f.Z.max()) < 0.3 and t.startZ.min() < 0.15
    failed = qsm.qsm_of(df.withColumn("foliage", F.lit(1))).collect()
    assert len(failed) == 2 and all(r["cyl_ID"] is None and "No wood" in r["message"] for r in failed)
    assert qsm.qsm_of(df.where("false")).count() == 0


def test_poly_rules_equal_the_single_tree(spark):
    rng = np.random.default_rng(2)
    n = 60
    t = pd.DataFrame({"cyl_ID": np.arange(1, n + 1), "axis_ID": np.where(np.arange(n) < 35, 1, np.where(np.arange(n) < 50, 2, 3)), "subtree_length": np.concatenate([np.linspace(7, 0.1, 35), np.linspace(3, 0.1, 15), np.linspace(1, 0.1, 10)]), "dist_to_root": np.concatenate([np.linspace(0, 6.9, 35), np.linspace(2, 5, 15), np.linspace(4, 5, 10)])})
    t["radius"] = np.where(rng.random(n) < 0.3, np.nan, 0.02 * t.subtree_length + 0.01 + rng.normal(0, 0.02, n)).clip(0.001)
    t.loc[50:54, "radius"] = np.nan
    t["quality"] = np.where(t.radius.isna(), 0, 4)
    want = qsm.tapered(t, 0.0025)
    df = spark.createDataFrame(t.assign(tree_id=1)).withColumn("radius", F.when(~F.isnan("radius"), F.col("radius")))
    got = trees.polynomial_fitting_root(trees.polynomial_fitting(df)).orderBy("cyl_ID").toPandas()
    assert np.allclose(got.radius.astype(float), want.radius, atol=1e-6, equal_nan=True) and (got.quality == want.quality).all()


def test_butts(spark):
    up = [(1, i, i - 1, 0.0, 0.0, 0.1 * i, 0.0, 0.0, 0.1 * (i + 1), 1, 0.1 * i) for i in range(4, 9)]
    flat = [(1, i, i - 1, 0.1 * (i - 4), 0.0, 0.4, 0.1 * (i - 3), 0.0, 0.4, 1, 0.1 * i) for i in range(1, 4)]
    df = spark.createDataFrame(flat + up, "tree_id long, cyl_ID long, parent_ID long, startX double, startY double, startZ double, endX double, endY double, endZ double, branch_order int, dist_to_root double")
    left = trees.drop_butt(df).collect()
    assert {r["cyl_ID"] for r in left} == {4, 5, 6, 7, 8} and {r["parent_ID"] for r in left if r["cyl_ID"] == 4} == {0}


def test_fits_that_overlap_are_one(spark):
    t = np.linspace(0, 2 * np.pi, 200)
    ring = np.c_[np.cos(t), np.sin(t)]
    assert not fitting.fit_multi(np.concatenate([ring, ring * 1.01]), 0.02, 2).success
    assert fitting.fit_multi(np.concatenate([ring, ring + [3, 0]]), 0.02, 2).success
    half = fitting.fit(np.c_[4 * np.cos(t / 2), 1.5 * np.sin(t / 2), 0 * t], 0.08)
    assert half.success and abs(half.radius - np.sqrt(6)) < 0.3 and half.shape_type == "ellipse"
    turn = np.array([[1, 0, 0], [0, np.sqrt(0.5), -np.sqrt(0.5)], [0, np.sqrt(0.5), np.sqrt(0.5)]])
    tilted = fitting.fit(np.c_[2 * np.cos(t), 2 * np.sin(t), 0 * t] @ turn.T, 0.15, "standard", (0, 0, 0), (0, -1, 1))
    assert tilted.success and abs(tilted.radius - 2) < 0.1 and tilted.arc_deg == 360


def test_tie_of_colours_and_rules(spark):
    p = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 1, 0), (3, None, 0, 0), (4, 2, 0, 3)], "point_id long, treeID int, foliage int, UserData int")
    c = {r["point_id"]: (r["R"], r["G"], r["B"]) for r in points.colour_trees(p).collect()}
    assert c[3] == c[4] == (150, 150, 150) and c[1] != c[3] and all(abs(b - int(a * 0.7)) <= 1 for a, b in zip(c[1], c[2], strict=True))
    r = spark.range(1).select(G.circle_valid(F.lit(0.03), F.lit(200.0), F.lit(40.0), F.lit(90.0)).alias("thin"), G.circle_valid(F.lit(0.2), F.lit(200.0), F.lit(50.0), F.lit(90.0)).alias("filled")).first()
    assert r["thin"] and not r["filled"] and Qsm().max_d == 0.1
