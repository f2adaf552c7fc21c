"""Tree-model operators on small trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boscage.operators import points, skeleton
from boscage.plans.queries import QUERIES

SHAPE = "tree_id int, cyl_ID int, parent_ID int, axis_ID int, branch_order int, startX double, startY double, startZ double, endX double, endY double, endZ double, subtree_length double, radius double, quality int"


def trunk(n, radius=lambda i: 0.1, x=lambda i: 0.0):
    return [(1, i, i - 1, 1, 1, x(i - 1), 0.0, float(i - 1), x(i), 0.0, float(i), float(n - i), radius(i), 5) for i in range(1, n + 1)]


def test_taubin_keeps_ends_and_lines():
    line = np.linspace(0, 1, 6)[:, None]
    assert skeleton.taubin(line, 15, -0.53) == pytest.approx(line)
    got = skeleton.taubin(np.array([[0.0], [1.0], [0.0]]), 1, -0.53)
    assert got[:, 0].tolist() == pytest.approx([0, 0.5 + 0.53 * 0.5, 0])
    assert skeleton.taubin(np.array([[1.0], [2.0]]), 3, -0.5).tolist() == [[1.0], [2.0]]


def test_smoothing_moves_branches_along(spark):
    rows = trunk(5, x=lambda i: 0.5 if i == 2 else 0.0)
    rows.append((1, 9, 2, 2, 2, 0.5, 0.0, 2.0, 1.5, 0.0, 2.0, 0.0, None, 0))
    got = {r["cyl_ID"]: r for r in skeleton.smooth_skeleton(spark.createDataFrame(rows, SHAPE)).collect()}
    assert 0 < got[2]["endX"] < 0.5 and got[5]["endX"] == 0 and got[1]["startX"] == 0
    assert got[9]["startX"] == got[3]["startX"] == got[2]["endX"] and got[9]["endX"] == 1.5


def test_radii_smoothing_and_unset(spark):
    even = skeleton.smooth_radii(spark.createDataFrame(trunk(5, lambda i: 0.2 if i == 3 else 0.1), SHAPE)).collect()
    assert all(r["radius"] >= 0.05 for r in even) and [r["radius"] for r in even if r["cyl_ID"] in (1, 5)] == [0.1, 0.1]
    unset = skeleton.smooth_radii(spark.createDataFrame(trunk(5, lambda i: None if i == 3 else 0.1 * i), SHAPE)).collect()
    assert [r["radius"] for r in sorted(unset) if r["cyl_ID"] != 3] == pytest.approx([0.1, 0.2, 0.4, 0.5])


def test_pipe_model_rules(spark):
    row = lambda i, p, s, r: (1, i, p, 1, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, s, r, 5)
    df = spark.createDataFrame([row(1, 0, 10.0, 0.5), row(2, 1, 5.0, None), row(3, 2, 3.0, None), row(4, 2, 4.0, None), row(5, 4, 0.0, None)], SHAPE)
    got = {r["cyl_ID"]: (r["radius"], r["quality"]) for r in skeleton.pipe_model(df, 0.01).collect()}
    two = 0.01 + 0.49 * 0.5
    assert got[1] == (0.5, 5) and got[2] == (pytest.approx(two), 2)
    assert got[3][0] == pytest.approx(two * 3 / 5) and got[4][0] == pytest.approx(two * 4 / 5) and got[5][0] == 0.01
    assert skeleton.pipe_model(df.withColumn("radius", F.lit(None).cast("double")), 0.01).where("radius <> 0.01").count() == 0


def test_prolongation_reaches_down(spark):
    df = spark.createDataFrame(trunk(8), SHAPE)
    got = skeleton.prolongate(df, spark.createDataFrame([(1, 0.35)], "tree_id int, prolong double"))
    low = got.orderBy("cyl_ID").collect()[:4]
    assert got.count() == 12 and [r["cyl_ID"] for r in low] == [-4, -3, -2, -1] and low[0]["startZ"] == pytest.approx(-0.35)
    assert low[3]["endZ"] == pytest.approx(0) and got.where("cyl_ID = 1 and parent_ID = -1").count() == 1
    assert low[0]["radius"] == pytest.approx(0.1 * 1.01**3) and low[0]["subtree_length"] == pytest.approx(7.35)
    assert skeleton.prolongate(df, spark.createDataFrame([], "tree_id int, prolong double")).count() == 8


def test_skeleton_chains_and_branches(spark):
    rows = [(1, i, 0, 0.0, 0.0, i * 0.5) for i in range(5)] + [(1, 3, 1, 0.6, 0.0, 1.5), (2, 0, 0, 0.0, 0.0, 0.0)]
    got = skeleton.skeleton(spark.createDataFrame(rows, "tree_id long, layer int, cluster int, X double, Y double, Z double"), 0.55).orderBy("cyl_ID").collect()
    assert [(r["cyl_ID"], r["parent_ID"]) for r in got] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 3)] and got[4]["startX"] == 0 and got[4]["endX"] == 0.6


def test_one_tree(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "treeID int, foliage int")
    assert points.one_tree(df.where("treeID = 1")).count() == 1
    with pytest.raises(ValueError):
        points.one_tree(df)


@pytest.mark.parametrize("name", ["smooth_skeleton", "smooth_radii", "prolongate", "skeleton_chains"])
def test_unordered_queries_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
