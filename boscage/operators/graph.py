"""Graphs and forests: components, shortest paths, folds over trees by pointer doubling.

All loops are level-synchronous joins whose state is checkpointed each round; the driver sees one count a round.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscage.operators._state import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes; component is the smallest node reachable over undirected (a, b).

    Star contraction: in turn, higher neighbours hang on a node's lowest one, and all neighbours on the lowest.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(e.join(low, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
    found = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.select("node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def reachable(edges: DataFrame, sources: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(node) reachable from the sources along (src, dst); with `places` as in shortest_paths(), block by block."""
    if places is not None:
        return shortest_paths(edges.select("src", "dst", F.lit(0.0).alias("cost")), sources, places).select("node")
    edges = cut(edges.select("src", "dst"))
    seen = cut(sources.select("node").distinct())
    front = seen
    while True:
        front = cut(front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front))


#: State of a block: nodes with their best ways, and (fresh) ways offered to them that nobody has looked at yet; `strict`
#: if the way's last step costs something.
_WAYS = "block long, node long, dist double, pred long, source long, fresh boolean, strict boolean"
_ROOT = np.iinfo(np.int64).min
#: Blocks that nodes without a place are dealt to.
SPREAD = 256


def _within_block(key: tuple, edges: pa.Table, state: pa.Table) -> pa.Table:
    """A block's state after Dijkstra's algorithm from what was offered to it, and what it offers to other blocks."""
    column = lambda t, c: np.asarray(t[c].combine_chunks().fill_null(_ROOT) if c == "pred" else t[c])
    fresh = column(state, "fresh")
    if not fresh.any():
        return state
    own = key[0].as_py()
    src, dst, cost, to = (column(edges, c) for c in ("src", "dst", "cost", "to"))
    ids, at = np.unique(np.concatenate([column(state, "node"), src, dst]), return_inverse=True)
    node, a, b = np.split(at, [state.num_rows, state.num_rows + len(src)])
    order = np.argsort(a, kind="stable")
    a, b, cost, to = a[order], b[order], cost[order], to[order]
    first = np.searchsorted(a, np.arange(len(ids) + 1)).tolist()
    ahead, price, inner = b.tolist(), cost.tolist(), (to == own).tolist()
    dist, source, pred = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64), np.full(len(ids), _ROOT)
    known = node[~fresh]
    for x, c in ((dist, "dist"), (source, "source"), (pred, "pred")):
        x[known] = column(state, c)[~fresh]
    dist, source, pred, name = dist.tolist(), source.tolist(), pred.tolist(), ids.tolist()
    heap: list[tuple[float, int, int]] = []
    changed = set()

    def offer(v: int, d: float, s: int, p: int, strict: bool) -> None:
        if d < dist[v] or (d == dist[v] and s < source[v]):
            dist[v], source[v], pred[v] = d, s, p
            changed.add(v)
            heapq.heappush(heap, (d, s, v))
        elif strict and d == dist[v] and s == source[v] and p < pred[v] != _ROOT:
            pred[v] = p

    for v, d, s, p, strict in zip(node[fresh].tolist(), *(column(state, c)[fresh].tolist() for c in ("dist", "source", "pred", "strict")), strict=True):
        offer(v, d, s, p, strict)
    while heap:
        d, s, v = heapq.heappop(heap)
        if d > dist[v] or s > source[v]:
            continue
        for i in range(first[v], first[v + 1]):
            if inner[i]:
                offer(ahead[i], d + price[i], s, name[v], d + price[i] > d)
    dist, source, pred = np.array(dist), np.array(source, np.int64), np.array(pred, np.int64)
    held = np.zeros(len(ids), bool)
    held[known], held[list(changed)] = True, True
    new = np.zeros(len(ids), bool)
    new[list(changed)] = True
    out = np.flatnonzero(new[a] & (to != own))
    way = dist[a[out]] + cost[out]
    strict = way > dist[a[out]]
    order = np.lexsort((ids[a[out]], ~strict, source[a[out]], way, b[out]))
    order = order[np.flatnonzero(np.append(True, np.diff(b[out][order]) != 0))[: len(order)]]
    best, out, way, strict = np.flatnonzero(held), out[order], way[order], strict[order]
    p = np.concatenate([pred[best], ids[a[out]]])
    rows = {"block": np.concatenate([np.full(len(best), own), to[out]]), "node": np.concatenate([ids[best], ids[b[out]]]), "dist": np.concatenate([dist[best], way]), "pred": pa.array(p, mask=p == _ROOT), "source": np.concatenate([source[best], source[a[out]]]), "fresh": np.repeat([False, True], [len(best), len(out)]), "strict": np.concatenate([np.zeros(len(best), bool), strict])}
    return pa.table({c: pa.array(x) if not isinstance(x, pa.Array) else x for c, x in rows.items()})


def _paths_by_block(edges: DataFrame, sources: DataFrame, places: DataFrame) -> DataFrame:
    """shortest_paths() where each round goes as far as blocks of nodes (node, block) reach; nodes without one are dealt out."""
    spread = lambda node, block: F.coalesce(block, -1 - F.pmod(F.xxhash64(node), F.lit(SPREAD))).cast("long").alias(block)
    at = lambda node, block: places.select(F.col("node").alias(node), F.col("block").alias(block))
    placed = edges.where("cost is not null").select("src", "dst", F.col("cost").cast("double").alias("cost")).join(at("src", "block"), "src", "left").join(at("dst", "to"), "dst", "left")
    placed = cut(placed.select("src", "dst", "cost", spread("src", "block"), spread("dst", "to")).repartition("block"))
    start = sources.select(F.col("node").cast("long").alias("node")).distinct().join(places, "node", "left")
    state = cut(start.select(spread("node", "block"), "node", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred"), F.col("node").alias("source"), F.lit(True).alias("fresh"), F.lit(True).alias("strict")))
    while True:
        state = cut(placed.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(_within_block, _WAYS))
        if state.where("fresh").isEmpty():
            return state.select("node", "dist", "pred", "source")


def shortest_paths(edges: DataFrame, sources: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(node, dist, pred, source): frontier relaxation of (src, dst, cost) from all (node) of sources.

    `places` (node, block) tells which nodes lie together (spatial.places()): a round then follows paths to the edges of
    blocks, so that rounds are as many as paths have blocks, not steps; a task holds a block.

    Edges are cut once.  Only nodes that improved in the last round are joined again; a round is one checkpoint, which
    holds the frontier as a mark.  Ties go to the smaller (source, predecessor).
    """
    if places is not None:
        return _paths_by_block(edges, sources, places)
    edges = cut(edges.select("src", "dst", "cost").repartition("src"))
    best = cut(sources.select("node", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred"), F.col("node").cast("long").alias("source"), F.lit(True).alias("fresh")).distinct())
    while True:
        front = best.where("fresh")
        step = front.join(edges, front["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((F.col("dist") + F.col("cost")).alias("dist"), "source", F.col("src").cast("long").alias("pred"))).alias("n"))
        better = F.col("n").isNotNull() & (F.col("dist").isNull() | (F.col("n.dist") < F.col("dist")))
        pick = lambda c: F.when(better, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c)
        best = cut(best.drop("fresh").join(step, "node", "full").select("node", pick("dist"), pick("pred"), pick("source"), F.coalesce(better, F.lit(False)).alias("fresh")))
        if best.where("fresh").isEmpty():
            return best.drop("fresh")


def find_paths(best: DataFrame, goals: DataFrame) -> DataFrame:
    """(goal, node, step) of the nodes from each (node) of goals back to its source, step counted from the goal.

    Predecessors are followed by doubling, so a path of n nodes takes log2(n) rounds.  A goal that has no distance has no row.
    """
    jump = cut(best.select("node", F.col("pred").alias("to")))
    found = cut(goals.select("node").distinct().join(best.select("node"), "node", "left_semi").select(F.col("node").alias("goal"), "node", F.lit(0).cast("long").alias("step")))
    reach = 1
    while not jump.where("to is not null").isEmpty():
        more = found.join(jump.where("to is not null"), "node").select("goal", F.col("to").alias("node"), (F.col("step") + reach).alias("step"))
        found = cut(found.unionByName(more))
        above = jump.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jump = cut(jump.where("to is not null").join(above, "to").select("node", F.col("next").alias("to")))
        reach *= 2
    return found


def passages(best: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(node, passage): number of targets (all nodes, if none are given) whose shortest path crosses each node.

    That is the number of targets in its subtree of the predecessor forest: counts go up by doubling, as in ancestors().
    """
    one = F.lit(1).cast("long")
    counted = best.select("node", "pred", one.alias("own")) if targets is None else best.join(targets.select("node", one.alias("hit")).distinct(), "node", "left").select("node", "pred", F.coalesce("hit", F.lit(0)).cast("long").alias("own"))
    now = cut(counted.select("node", F.col("pred").alias("to"), F.col("own").alias("passage")))
    while not now.where("to is not null").isEmpty():
        # each node holds the count of its subtree's first 2^k levels; the next 2^k are held by the nodes 2^k below it
        below = now.where("to is not null").groupBy("to").agg(F.sum("passage").alias("more")).withColumnRenamed("to", "node")
        above = now.select(F.col("node").alias("to"), F.col("to").alias("next"))
        now = cut(now.join(below, "node", "left").join(above, "to", "left").select("node", F.col("next").alias("to"), (F.col("passage") + F.coalesce("more", F.lit(0))).alias("passage")))
    return now.select("node", "passage")


def ancestors(tree: DataFrame, key: list[str], value: dict[str, Column], up: bool) -> DataFrame:
    """Pointer doubling over (*key, node, parent) rows: log2(depth) rounds for any shape of forest.

    up=False: each value becomes its sum from the root down to the node (inclusive).
    up=True: each value becomes its maximum over the node's subtree (inclusive).
    A cycle has no root, so pointers that outlive log2(rows) rounds are an error.
    """
    names = list(value)
    now = cut(tree.select(*key, "node", F.col("parent").alias("to"), *(v.alias(n) for n, v in value.items())))
    rounds = now.count().bit_length() + 1
    while True:
        if now.where("to is not null").isEmpty():
            return now.select(*key, "node", *names)
        if not rounds:
            raise ValueError("the parents go round in a cycle")
        rounds -= 1
        above = now.select(*key, F.col("node").alias("to"), F.col("to").alias("next"), *(F.col(n).alias(f"_{n}") for n in names))
        if up:
            below = now.where("to is not null").groupBy(*key, "to").agg(*(F.max(n).alias(f"_{n}") for n in names)).withColumnRenamed("to", "node")
            merged = now.join(below, [*key, "node"], "left").withColumns({n: F.greatest(n, f"_{n}") for n in names}).drop(*(f"_{n}" for n in names))
            now = cut(merged.join(above.select(*key, "to", "next"), [*key, "to"], "left").select(*key, "node", F.col("next").alias("to"), *names))
        else:
            now = cut(now.join(above, [*key, "to"], "left").select(*key, "node", F.col("next").alias("to"), *((F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names)))
