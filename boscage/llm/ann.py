"""Approximate nearest neighbours (operator 10): balanced posting lists with replicated boundary vectors.

Fit (driver, bounded sample): balanced k-means gives the lists' centroids; each centroid is joined with its nearest
ones in an in-memory graph.  Index (all vectors): a vector goes to its nearest centroid and, if it lies near a boundary
(distance within a ratio of the nearest), to further centroids, but not behind one that is closer to it than to
the vector.  Search: the graph is walked best-first from a fixed entry; lists whose centroid is within a distance ratio of the
query's nearest are selected and read.  Short lists that lie together share a group, a long list is many groups, and queries
of a group are dealt in blocks; so a task is bounded, and gives each of its queries' ten best over all lists of the group by
exact distance in double precision; the ten best of those are the result.  A query whose lists hold
fewer than k candidates is compared with every vector, in blocks.

Edge cases: vectors that are null, zero, of another length, or hold null or non-finite components take no part; a query
never finds its own row, but finds repeated rows of itself; ties go to the smaller vec_id (null last); with fewer candidates
than k all are returned; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boscage.llm._common import shared_dir, written
from boscage.llm._vectors import distances, kmeans, sample, stacked, valid

#: Vectors of a list on average, most lists, neighbours in the centroid graph, rows of a block.
PER_LIST, LISTS, DEGREE, BLOCK = 250, 4096, 24, 1024
#: A boundary vector is replicated to lists within this ratio of its nearest, COPIES lists at most in all.
BOUNDARY, COPIES = 1.08, 4
#: Lists within this ratio of the distance to a query's nearest centroid are read, and the FLOOR nearest ones always (a query
#: that equals a centroid has distance 0, of which no ratio selects a second list).
RATIO, FLOOR = 1.4, 4
#: Vectors of a group of lists, and of a block where a query is compared with all.
GROUP = 4 * BLOCK


def grouped(sizes: dict[int, int], centroids: np.ndarray) -> dict[int, tuple[int, int]]:
    """The (first group, number of groups) of each list: neighbours along the main axis share one of GROUP vectors."""
    if not sizes:
        return {}
    centred = centroids - centroids.mean(0)
    axis = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
    out, at, room = {}, -1, 0
    for c in sorted(sizes, key=lambda c: (axis[c], c)):
        if sizes[c] > room:
            at, room = at + 1, max(GROUP, sizes[c])
        blocks = -(-sizes[c] // GROUP)
        out[c] = (at, blocks)
        at, room = at + blocks - 1, 0 if blocks > 1 else room - sizes[c]
    return out


class Index:
    def __init__(self, x: np.ndarray, lists: int):
        self.centroids = kmeans(x, lists, 10, balance=0.02)
        d = distances(self.centroids, self.centroids)
        # links hold both ways, and a ring holds the graph together: else centroids that are nobody's neighbour are never found
        n = len(d)
        links = np.zeros((n, n), bool)
        np.put_along_axis(links, np.argsort(d, axis=1)[:, 1 : DEGREE + 1], True, axis=1)
        links[np.arange(n), (np.arange(n) + 1) % n] = True
        links |= links.T
        np.fill_diagonal(links, False)
        self.near = [np.flatnonzero(row) for row in links]
        self.entry = int(distances(self.centroids, self.centroids.mean(0, keepdims=True)).argmin())

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every vector's postings."""
        d = np.sqrt(distances(x, self.centroids))
        order = np.argsort(d, axis=1)[:, : 4 * COPIES]
        rows, lists = [np.arange(len(x))], [order[:, 0]]
        taken = order[:, :1]
        count = np.ones(len(x), np.int64)
        for j in range(1, order.shape[1]):
            c = order[:, j]
            dist = d[np.arange(len(x)), c]
            ok = (dist <= BOUNDARY * d[np.arange(len(x)), order[:, 0]]) & (count < COPIES)
            # not a list whose centroid lies closer to one already taken than to the vector
            between = np.sqrt(((self.centroids[taken] - self.centroids[c][:, None]) ** 2).sum(-1))
            ok &= (np.where(taken >= 0, between, np.inf) > dist[:, None]).all(1)
            taken = np.concatenate([taken, np.where(ok, c, -1)[:, None]], 1)
            count += ok
            rows.append(np.flatnonzero(ok))
            lists.append(c[ok])
        return np.concatenate(rows), np.concatenate(lists)

    def search(self, q: np.ndarray) -> np.ndarray:
        """Lists to read for one query: best-first over the centroid graph while it finds lists within the ratio."""
        first = float(np.sqrt(((self.centroids[self.entry] - q) ** 2).sum()))
        seen, best = {self.entry: first}, first
        todo = [(first, self.entry)]
        while todo:
            dist, c = heapq.heappop(todo)
            if dist > best * (RATIO + 0.1) and len(seen) > 64:
                break
            new = [i for i in self.near[c].tolist() if i not in seen]
            if new:
                for i, v in zip(new, np.sqrt(((self.centroids[new] - q) ** 2).sum(1)).tolist(), strict=True):
                    seen[i] = v
                    best = min(best, v)
                    heapq.heappush(todo, (v, i))
        reach = sorted(seen.values())[min(FLOOR, len(seen)) - 1]
        return np.array([i for i, v in seen.items() if v <= max(best * RATIO, reach)], np.int32)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest others by Euclidean distance, among (vec_id, embedding)."""
    spark = vectors.sparkSession
    work = shared_dir(spark)
    rows, width = valid(vectors, f"{work}/valid")
    rows = rows.where("vec is not null")
    n = rows.count()
    held = spark.sparkContext.broadcast(Index(sample(rows, n, width), int(min(LISTS, max(1, n // PER_LIST)))))  # at most LISTS centroids

    def post(batches):
        for b in batches:
            at, lists = held.value.assign(stacked(b.column(2), width))
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *(b.column(i).take(pa.array(at)) for i in range(3))], ["list", "rid", "vec_id", "vec"])

    shape = "list int, rid long, vec_id long, vec binary"
    posted = written(rows.mapInArrow(post, shape), f"{work}/posted")
    sizes = {x["list"]: x["n"] for x in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS rows at most
    groups = grouped(sizes, held.value.centroids)

    def probe(batches):
        for b in batches:
            out = [], [], []
            for i, q in enumerate(stacked(b.column(2), width)):
                reads: dict[int, list[int]] = {}
                for c in held.value.search(q).tolist():
                    first, blocks = groups.get(c, (0, 0))
                    for g in range(first, first + blocks):
                        reads.setdefault(g, []).append(c)
                for g, lists in reads.items():
                    for col, v in zip(out, (i, g, lists), strict=True):
                        col.append(v)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int32())), *(b.column(i).take(at) for i in range(3))], ["group", "lists", "rid", "vec_id", "vec"])

    asked = written(rows.where(is_query).mapInArrow(probe, "group int, lists array<int>, rid long, vec_id long, vec binary"), f"{work}/asked")
    asks = {x["group"]: -(-x["q"] // BLOCK) for x in asked.groupBy("group").agg(F.count("*").alias("q")).collect()}  # a row per group
    lookup = lambda d: F.create_map(*[F.lit(v) for x in d.items() for v in x]) if d else F.create_map(F.lit(-1), F.lit(0))
    salt = F.xxhash64("rid", F.lit(3))
    place, blocks = lookup({c: g for c, (g, _) in groups.items()}), lookup({c: n for c, (_, n) in groups.items()})
    of_group, none = lookup(asks), F.lit(None).cast("array<int>")
    side_m = posted.withColumn("group", (place[F.col("list")] + F.pmod(salt, blocks[F.col("list")])).cast("int")).where(of_group[F.col("group")].isNotNull())
    side_m = side_m.withColumn("qb", F.explode(F.sequence(F.lit(0), of_group[F.col("group")] - 1))).withColumns({"lists": none, "asks": F.lit(False)})
    side_q = asked.withColumns({"list": F.lit(None).cast("int"), "qb": F.pmod(salt, of_group[F.col("group")]).cast("int"), "asks": F.lit(True)})

    def compare(key, table):
        asks = np.asarray(table["asks"])
        q, m = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        x, y = stacked(q["vec"], width), stacked(m["vec"], width)
        rid, first, same = np.unique(np.asarray(m["rid"]), return_index=True, return_inverse=True)  # a replicated vector counts once
        y, names = y[first], m["vec_id"].combine_chunks().take(pa.array(first))
        ids = np.asarray(names.fill_null(np.iinfo(np.int64).max))
        queries, own = np.asarray(q["rid"]), q["vec_id"].combine_chunks()
        rough = distances(x, y)
        rough[queries[:, None] == rid[None]] = np.inf
        if "lists" in table.column_names:
            reads = q["lists"].combine_chunks()
            asked_of = np.repeat(np.arange(len(x)), np.asarray(pc.list_value_length(reads)))
            held_by, to_read, read = np.asarray(m["list"]), np.asarray(reads.flatten()), np.zeros(rough.shape, bool)
            for c in np.unique(held_by):
                read[np.ix_(asked_of[to_read == c], same[held_by == c])] = True
            rough[~read] = np.inf
        out_q, out_m, out_d = [], [], []
        for i in range(len(x)):
            edge = np.partition(rough[i], k - 1)[k - 1] if len(y) > k else np.inf
            pick = np.flatnonzero((rough[i] <= edge * (1 + 1e-9) + 1e-9) & np.isfinite(rough[i]))
            d = np.sqrt(((y[pick] - x[i]) ** 2).sum(1))
            keep = np.lexsort((rid[pick], ids[pick], d))[:k]
            out_q.append(np.full(len(keep), i))
            out_m.append(pick[keep])
            out_d.append(d[keep])
        a, b, d = (np.concatenate(v) if v else np.zeros(0) for v in (out_q, out_m, out_d))
        a, b = pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))
        return pa.table({"q": pa.array(queries).take(a), "query_id": own.take(a), "m": pa.array(rid).take(b), "vec_id": names.take(b), "score": pa.array(d, pa.float64())})

    def ranked(dealt: DataFrame, *key: str) -> DataFrame:
        best = dealt.groupBy(*key).applyInArrow(compare, "q long, query_id long, m long, vec_id long, score double")
        once = best.groupBy("q", "m").agg(F.first("query_id").alias("query_id"), F.first("vec_id").alias("vec_id"), F.min("score").alias("score"))
        order = Window.partitionBy("q").orderBy("score", F.col("vec_id").asc_nulls_last(), "m")
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "query_id", "rank", "vec_id", "score")

    found = written(ranked(side_m.unionByName(side_q), "group", "qb"), f"{work}/found")
    shape = ("query_id", "rank", "vec_id", "score")
    full = found.groupBy("q").agg(F.count("*").alias("c")).where(F.col("c") >= min(k, n - 1)).select(F.col("q").alias("rid"))
    short = written(rows.where(is_query).join(full, "rid", "left_anti"), f"{work}/short")
    left = short.count() if n > 1 else 0
    if not left:
        return found.select(*shape)
    mb, qb = -(-n // GROUP), -(-left // BLOCK)
    every = rows.withColumn("mb", F.pmod(salt, F.lit(mb)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))).withColumn("asks", F.lit(False))
    asking = short.withColumn("qb", F.pmod(salt, F.lit(qb)).cast("int")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.lit(mb - 1)))).withColumn("asks", F.lit(True))
    exact = ranked(every.unionByName(asking), "mb", "qb")
    return found.join(short.select(F.col("rid").alias("q")), "q", "left_anti").unionByName(exact).select(*shape)
