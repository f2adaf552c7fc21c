"""Nearest points of queries that lie far from them, against brute force."""

import numpy as np

from boscage.operators import spatial


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, x, strict=True)], "point_id long, X double, Y double, Z double")


def brute(ids, x, q, k):
    out = []
    for at in q:
        d2 = ((at - x) ** 2).sum(1)
        order = np.lexsort((ids, d2))[:k]
        out.append([(int(ids[i]), float(d2[i])) for i in order])
    return out


def check(found, queries, want):
    got = {}
    for r in found.collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (r["point_id"], r["d2"])
    for i, w in zip(queries, want, strict=True):
        mine = [got[int(i)][n] for n in range(1, len(w) + 1)]
        assert [m[0] for m in mine] == [x[0] for x in w] and np.allclose([m[1] for m in mine], [x[1] for x in w], rtol=1e-12) and len(got[int(i)]) == len(w)


def test_far_queries_look_into_few_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.random((6000, 3)) * [2, 0.3, 10] * 4) / 4 + np.round(rng.random((6000, 3)), 2) * (rng.random((6000, 1)) < 0.5)  # with copies and equal distances
    x[:500] = x[0]
    ids = rng.permutation(6000)
    q = np.concatenate([rng.normal(size=(60, 3)) * 6, x[:5], [[1e4, -1e4, 3]]])
    calls, plain = [], spatial.neighbours
    monkeypatch.setattr(spatial, "neighbours", lambda *a: calls.append(1) or plain(*a))
    check(spatial.knn_join(frame(spark, range(len(q)), q), frame(spark, ids, x), 10), range(len(q)), brute(ids, x, q, 10))
    assert len(calls) == 1  # doubled cells came to pair every far query with every point
    check(spatial.knn_by_blocks(frame(spark, range(len(q)), q), frame(spark, ids, x), len(x), 600), range(len(q)), brute(ids, x, q, 600))


def test_fewer_points_than_asked_for_and_points_without_a_place(spark):
    x = np.array([[0.0, 0, 0], [1, 0, 0], [1, 0, 0], [5, 5, 5]])
    points = frame(spark, range(4), x).unionByName(spark.sql("SELECT 9L AS point_id, CAST(NULL AS DOUBLE) AS X, 0D AS Y, 0D AS Z"))
    q = np.array([[40.0, 0, 0], [0, 0, 0.1]])
    check(spatial.knn_by_blocks(frame(spark, [7, 8], q), points, 5, 6), [7, 8], brute(np.arange(4), x, q, 6))
    check(spatial.knn_join(frame(spark, [7, 8], q), points, 6), [7, 8], brute(np.arange(4), x, q, 6))
    check(spatial.knn_join(frame(spark, [7, 8], q), points, 3), [7, 8], brute(np.arange(4), x, q, 3))
