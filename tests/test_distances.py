"""Queries of distances to cylinders against brute force on the smallest tables."""

from collections import defaultdict

import numpy as np

from boscage.plans.queries import QUERIES, emb, evt, heap

SF = "/root/testdata/sf0.001"


def arrays(rows, *names):
    return [np.array([r[n] for r in rows], float) for n in names]


def surface(p, c):
    """(points, cylinders) distances to capped cylinders, and to their midpoints squared."""
    a, b = np.stack(arrays(c, "startX", "startY", "startZ"), 1), np.stack(arrays(c, "endX", "endY", "endZ"), 1)
    (r,) = arrays(c, "radius")
    x, d = np.stack(arrays(p, "X", "Y", "Z"), 1)[:, None], b - a
    n = np.sqrt((d * d).sum(1))
    t = ((x - a) * d).sum(2) / n**2
    out = np.maximum(0, np.linalg.norm(x - a - t[..., None] * d, axis=2) - r)
    along = np.maximum(0, np.maximum(-t, t - 1)) * n
    return np.sqrt(along**2 + out**2), ((x - (a + b) / 2) ** 2).sum(2)


def long_cylinders(spark):
    return [r for r in heap(spark, SF).collect() if sum((r[f"end{a}"] - r[f"start{a}"]) ** 2 for a in "XYZ") > 1e-18]


def test_every_cylinder_of_the_tree(spark):
    trees, points = defaultdict(list), defaultdict(list)
    for c in long_cylinders(spark):
        trees[c["tree_id"]].append(c)
    for p in evt(spark, SF).collect():
        points[p["treeID"]].append(p)
    pairs, leaf = {}, {}
    for tree, ps in points.items():
        dist, _ = surface(ps, cs := trees[tree])
        off = (dist - 1.3 * arrays(cs, "radius")[0]).min(1)
        for i, p in enumerate(ps):
            leaf[p["point_id"]] = int(off[i] >= 0.02)
            pairs.update({(p["point_id"], c["cyl_ID"]): dist[i, j] for j, c in enumerate(cs)})
    got = {(r["point_id"], r["cyl_ID"]): r["dist"] for r in QUERIES["point_cyl_distance"](spark, SF).collect()}
    assert got.keys() == pairs.keys() and max(abs(got[k] - pairs[k]) for k in pairs) < 1e-5
    assert {r["point_id"]: r["foliage"] for r in QUERIES["segment_by_model"](spark, SF).collect()} == leaf


def test_ten_nearest_midpoints_of_all_trees(spark, tmp_path):
    rng = np.random.default_rng(5)
    spark.read.parquet(f"{SF}/events.parquet").where("event_id < 240").selectExpr("event_id", "ts", "event_id % 40 + 1 AS user_id", "value").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, rng.normal(size=3).tolist(), 0) for i in range(30)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    cs = [r for r in heap(spark, str(tmp_path)).collect() if sum((r[f"end{a}"] - r[f"start{a}"]) ** 2 for a in "XYZ") > 1e-18]
    ps = emb(spark, str(tmp_path)).collect()
    dist, middle = surface(ps, cs)
    near = np.argsort(middle, axis=1)[:, :10]
    want = {p["point_id"]: dist[i, near[i]].min() for i, p in enumerate(ps)}
    got = {r["point_id"]: r["dist"] for r in QUERIES["model_distances"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-5
