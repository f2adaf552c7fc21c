"""Trees of a tile whose mean place lies on the tile's edge."""

import numpy as np
from pyspark.sql import functions as F

from boscage.operators import spatial


def test_means_on_an_edge_do_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for tree in range(1, 401):
        half = [int(x) for x in rng.integers(1, 100, 9)]
        xs = [(400 + k) / 100 for k in (*half, *(-k for k in half))]  # their mean is 4, but for the last digits
        rng.shuffle(xs)
        ids = [tree * 100 + i for i in range(len(xs))]
        total = 0.0
        for x in xs:
            total += x
        rows += [(i, tree, x, 1.0) for i, x in zip(ids, xs, strict=True)]
        want |= {(i, int(total / len(xs) // 4)) for i in ids}
    points = spark.createDataFrame(rows, "point_id long, treeID long, X double, Y double").repartition(7).orderBy(F.rand(1)).repartition(5)
    tiled = points.withColumns({"tx": F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))), "ty": F.lit(0).cast("long")})
    got = spatial.trees_of_tile(tiled, tiled, 4).select("point_id", "tx").collect()
    assert {(r[0], r[1]) for r in got} == want and len(got) == len(want) and {t for _, t in want} == {0, 1}
