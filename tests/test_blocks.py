"""Shortest paths block by block: as those round by round, in as many rounds as paths have blocks."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from boscage.operators import graph


def dijkstra(edges, sources):
    """{node: (dist, source, pred)}; ties to the smaller source, then the smaller predecessor."""
    ahead = {}
    for a, b, c in edges:
        ahead.setdefault(a, []).append((b, c))
    best, heap = {}, [(0.0, s, -1, s) for s in sources]
    heapq.heapify(heap)
    while heap:
        d, s, p, v = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = (d, s, p)
        for w, c in ahead.get(v, []):
            heapq.heappush(heap, (d + c, s, v, w))
    return best


@pytest.mark.parametrize("whole", [True, False])
def test_as_dijkstra(spark, whole):
    r = np.random.default_rng(2)
    pairs = r.integers(0, 200, (700, 2)).tolist()
    edges = [(a, b, float(r.integers(1, 6))) for a, b in pairs if a != b]  # whole costs: many ties
    want = dijkstra(edges, [3, 77])
    df, sources = spark.createDataFrame(edges, "src long, dst long, cost double"), spark.createDataFrame([(3,), (77,)], "node long")
    places = spark.range(0, 200 if whole else 120).select(F.col("id").alias("node"), (F.col("id") % 5).alias("block"))  # some have none
    got = {x.node: (x.dist, x.source, -1 if x.pred is None else x.pred) for x in graph.shortest_paths(df, sources, places).collect()}
    assert got == want
    assert {x.node for x in graph.reachable(df, sources, places).collect()} == set(want)


def test_rounds(spark, monkeypatch):
    n, rounds = 400, []
    monkeypatch.setattr(graph, "cut", lambda df, was=graph.cut: rounds.append(1) or was(df))
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0.5).alias("cost"))
    places = spark.range(n + 1).select(F.col("id").alias("node"), F.expr("id div 100").alias("block"))
    got = graph.shortest_paths(edges, spark.range(1).select(F.col("id").alias("node")), places)
    assert got.count() == n + 1 and got.agg(F.max("dist")).first()[0] == n / 2
    assert len(rounds) < 12


def test_steps_for_nothing_make_no_cycle(spark):
    edges = spark.createDataFrame([(0, 4, 1.0), (4, 3, 0.0), (3, 4, 0.0), (3, 2, 0.0), (2, 3, 0.0), (0, 2, 1.0)], "src long, dst long, cost double")
    places = spark.createDataFrame([(0, 0), (2, 1), (3, 2), (4, 1)], "node long, block long")
    best = graph.shortest_paths(edges, spark.range(1).select(F.col("id").alias("node")), places)
    up = {x.node: x.pred for x in best.collect()}
    for v in up:
        seen = set()
        while v is not None:
            assert v not in seen
            seen.add(v)
            v = up[v]
