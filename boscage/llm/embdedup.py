"""Embedding near-duplicates (operator 5): product quantisation with coarse lists, then an exact cosine check.

Index: coarse centroids (k-means on a bounded sample) give inverted lists, their number in proportion to the rows; beyond FLAT
lists the centroids are sums over levels of residual codebooks.  The residuals of the unit vectors are coded by subspace
codebooks.  Every vector is in the list of its nearest centroid, and carries its codes and its coding error.
Probing: a vector looks into its own list and into those whose centroids are farther than its own by no more than a margin
(of squared distance).  The margin is calibrated on sampled vectors with made partners at exactly the threshold, so that
SURE of these pairs have one end at least that probes the other's list; closer pairs are found more often.  With `exact`,
a vector probes every list that the plane between the two centroids doesn't rule out: no link is lost, at quadratic cost.
There, distances come from the vector's lookup tables and the codes; a member whose table distance less its coding error
exceeds r = sqrt(2-2t) can't be a link.  What is left is checked by exact cosine in double precision.

Work: equal vectors are one class from the start.  Lists are dealt in blocks of members and of queries, so no task grows
with a list.  A block tells each vector's number of links and its local component, never the pairs.

Edge cases: vectors that are null, zero, of another length, or hold null or non-finite components link with nothing;
repeated rows are links of each other; a null vec_id takes part but is never a component's name; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.llm._common import components, local_components, shared_dir, written
from boscage.llm._vectors import distances, kmeans, sample, stacked, valid

#: Vectors of a list on average, centroids of a level, kept prefixes of centroids, codes of a subspace, its width, rows of a block.
PER_LIST, FLAT, BEAM, CODES, SUB, BLOCK = 100, 1024, 64, 64, 4, 1024
#: Share of made partners that the calibrated margin finds.
SURE = 0.999
#: Lists longer than a block whose sizes may be broadcast; more are joined by a shuffle.
BROADCAST = 200_000


class Index:
    def __init__(self, units: np.ndarray, lists: int, width: int, threshold: float, exact: bool = False):
        self.r, self.width = math.sqrt(max(0.0, 2 - 2 * threshold)), width
        levels = 1 if exact else max(1, math.ceil(math.log(max(2, lists)) / math.log(FLAT) - 1e-9))
        self.coarse, rest = [], units
        for _ in range(levels):
            self.coarse.append(kmeans(rest, math.ceil(min(lists, FLAT) if levels == 1 else lists ** (1 / levels))))
            rest = rest - self.coarse[-1][distances(rest, self.coarse[-1]).argmin(1)]
        self.shared = {(i, j): self.coarse[i] @ self.coarse[j].T for j in range(levels) for i in range(j)}
        self.gap = np.maximum(np.sqrt(distances(self.coarse[0], self.coarse[0])), 1e-12) if exact else None
        rest = units - self.centroid(self.probes(units)[0])
        self.cuts = [(a, min(a + SUB, width)) for a in range(0, max(width, 1), SUB)]
        self.books = [kmeans(rest[:, a:b], CODES, 6) for a, b in self.cuts]
        self.margin = 0.0 if exact else self._margin(units, threshold)

    def centroid(self, cell: np.ndarray) -> np.ndarray:
        """The centroid of each list: the sum of its levels' entries, the last level being the lowest digit."""
        out, left = 0.0, np.asarray(cell)
        for book in reversed(self.coarse):
            out, left = out + book[left % len(book)], left // len(book)
        return out

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lists, squared distances) of each row's nearest lists: all of one level, or the BEAM best of several."""
        ids, d = np.zeros((len(x), 1), np.int64), (x * x).sum(1)[:, None]
        digits: list[np.ndarray] = []
        for level, book in enumerate(self.coarse):
            step = ((book * book).sum(1) - 2 * x @ book.T)[:, None, :] + d[:, :, None]
            for i, own in enumerate(digits):
                step = step + 2 * self.shared[i, level][own]
            n, b, k = step.shape
            flat = step.reshape(n, b * k)
            if level == 0 and len(self.coarse) == 1:
                return np.broadcast_to(np.arange(k), (n, k)), flat
            best = np.argpartition(flat, min(BEAM, b * k) - 1, axis=1)[:, :BEAM] if b * k > BEAM else np.broadcast_to(np.arange(b * k), (n, b * k))
            at, new = best // k, best % k
            digits = [np.take_along_axis(o, at, 1) for o in digits] + [new]
            ids, d = np.take_along_axis(ids, at, 1) * k + new, np.take_along_axis(flat, best, 1)
        return ids, d

    def probes(self, units: np.ndarray, margin: float = 0.0) -> tuple[np.ndarray, list[np.ndarray]]:
        """(own list, lists to probe in order) of each unit vector."""
        own, lists = np.zeros(len(units), np.int64), []
        for s in range(0, len(units), 128):
            ids, d = self.cells(units[s : s + 128])
            low = d.argmin(1)
            rows = np.arange(len(low))
            own[s : s + 128] = ids[rows, low]
            if self.gap is not None:
                near = (d - d[rows, low][:, None]) / (2 * self.gap[low]) <= self.r + 1e-9
            else:
                near = d <= d[rows, low][:, None] + margin
            near[rows, low] = True
            lists += [np.sort(i[k]) for i, k in zip(ids, near, strict=True)]
        return own, lists

    def _margin(self, units: np.ndarray, threshold: float) -> float:
        """The margin by which SURE of made pairs at the threshold find each other from one end at least."""
        rng = np.random.default_rng(11)
        x = units[:4096]
        if not len(x) or self.width < 2:
            return 4.0
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        needs = np.full(len(x), np.inf)
        for s in range(0, len(x), 128):
            (ix, dx), (iy, dy) = self.cells(x[s : s + 128]), self.cells(y[s : s + 128])
            rows = np.arange(len(ix))
            for ids, d, others, other in ((ix, dx, iy, dy), (iy, dy, ix, dx)):
                home = others[rows, other.argmin(1)]
                gap = np.where(ids == home[:, None], d, np.inf).min(1) - d.min(1)
                needs[s : s + 128] = np.minimum(needs[s : s + 128], gap)
        found = np.quantile(needs, SURE, method="higher")
        return float(found) if np.isfinite(found) else float(np.max(needs[np.isfinite(needs)], initial=0.0))

    def code(self, units: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, coding error) of unit vectors in the lists `own`."""
        rest = units - self.centroid(own)
        codes = np.stack([distances(rest[:, a:b], book).argmin(1) for (a, b), book in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        error = np.sqrt(sum(((rest[:, a:b] - book[codes[:, i]]) ** 2).sum(1) for i, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True))))
        return codes, error

    def table_distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded members of list `at`, by table lookup."""
        rest = (queries - self.centroid(np.int64(at))).astype(np.float32)
        total = np.zeros((len(queries), len(codes)), np.float32)
        for i, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            total += distances(rest[:, a:b], book.astype(np.float32)).take(codes[:, i], axis=1)
        return np.sqrt(total)


def _ragged(lists: list[np.ndarray]) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))


def link_groups(vectors: DataFrame, threshold: float = 0.9, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    work = shared_dir(spark)
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind = np.dtype("<f4" if single else "<f8")  # floats travel as floats: their doubles are the same numbers
    rows, width = valid(vectors, f"{work}/valid")
    keyed = rows.where("vec is not null").select("rid", "vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit(1)).alias("h2"))
    classes = written(keyed.groupBy("h1", "h2").agg(F.min("rid").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("times"), F.min_by("vec", "rid").alias("vec")), f"{work}/classes")
    n = classes.count()
    units = sample(classes.withColumnRenamed("node", "rid"), n, width)
    units = units / np.linalg.norm(units, axis=1, keepdims=True) if len(units) else units
    held = spark.sparkContext.broadcast(Index(units, max(1, n // PER_LIST), width, threshold, exact))  # a few levels of FLAT centroids at most

    def unit(col: pa.Array) -> np.ndarray:
        x = stacked(col, width, kind)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def assign(batches):
        index = held.value
        for b in batches:
            x = stacked(b.column(2), width)
            narrow = x.astype(kind)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            own, lists = index.probes(x, index.margin)
            codes, error = index.code(x, own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own), _ragged(lists), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float32)), pa.array([v.tobytes() for v in narrow], pa.binary())], ["node", "times", "list", "probes", "codes", "error", "vec"])

    coded = written(classes.select("node", "times", "vec").mapInArrow(assign, "node long, times long, list long, probes array<long>, codes binary, error float, vec binary"), f"{work}/coded")
    asked = coded.withColumn("home", F.col("list")).withColumn("list", F.explode("probes"))
    # long lists are split into blocks of members and of queries; of such there are at most rows * probes / BLOCK
    members = coded.groupBy("list").agg(F.count("*").alias("n"))
    sizes = asked.groupBy("list").agg(F.count("*").alias("q")).join(members, "list").where(F.greatest("n", "q") > BLOCK)
    sizes = written(sizes.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("ms"), F.ceil(F.col("q") / (4 * BLOCK)).cast("int").alias("qs")), f"{work}/sizes")
    if sizes.count() <= BROADCAST:
        sizes = F.broadcast(sizes)
    salt = F.xxhash64("node", F.lit(9))
    ms, qs = F.coalesce("ms", F.lit(1)), F.coalesce("qs", F.lit(1))
    every = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    side_m = coded.join(sizes, "list", "left").withColumn("mb", F.pmod(salt, ms).cast("int")).withColumn("qb", every(qs)).select("list", "mb", "qb", F.lit(False).alias("asks"), "node", "times", F.col("list").alias("home"), "probes", "codes", "error", "vec")
    side_q = asked.join(sizes, "list", "left").withColumn("qb", F.pmod(salt, qs).cast("int")).withColumn("mb", every(ms))
    side_q = side_q.select("list", "mb", "qb", F.lit(True).alias("asks"), "node", "times", "home", F.lit(None).cast("array<long>").alias("probes"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("error"), "vec")

    def compare(key, table):
        index, at = held.value, key[0].as_py()
        asks = np.asarray(table["asks"])
        q, m = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        out = {"node": [], "links": [], "local": []}
        if q.num_rows and m.num_rows:
            mu, mn, mt, me = unit(m["vec"]), np.asarray(m["node"]), np.asarray(m["times"]), np.asarray(m["error"])
            codes = np.frombuffer(b"".join(m["codes"].to_pylist()), np.uint8).reshape(len(mn), -1)
            probed = m["probes"].combine_chunks()
            at_of = np.repeat(np.arange(len(mn)), np.asarray(probed.value_lengths()))
            listed = np.asarray(probed.flatten())
        for s in range(0, q.num_rows if m.num_rows else 0, BLOCK):
            part = q.slice(s, BLOCK)
            qu, qn, qt, home = unit(part["vec"]), np.asarray(part["node"]), np.asarray(part["times"]), np.asarray(part["home"])
            near = index.table_distances(qu, at, codes) <= (index.r + me + 1e-4)[None]
            near &= (home != at)[:, None] | (qn[:, None] < mn[None])
            a, b = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if not len(a):
                continue
            links = (qu[a] @ mu[b].T >= threshold) & near[np.ix_(a, b)]
            for h in np.unique(home[a][(home[a] > at) & links.any(1)]).tolist():  # pairs that the other end sees as well
                also = np.zeros(len(mn), bool)
                also[at_of[listed == h]] = True
                links[np.ix_(home[a] == h, also[b])] = False
            a, b, links = a[links.any(1)], b[links.any(0)], links[np.ix_(links.any(1), links.any(0))]
            if not len(a):
                continue
            ql, ml = local_components(links, qn[a], mn[b])
            out["node"] += [qn[a], mn[b]]
            out["links"] += [links @ mt[b], qt[a] @ links]
            out["local"] += [ql, ml]
        return pa.table({k: pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for k, v in out.items()})

    found = written(side_m.unionByName(side_q).groupBy("list", "mb", "qb").applyInArrow(compare, "node long, links long, local long"), f"{work}/found")
    linked = components(found.select(F.col("node").alias("a"), F.col("local").alias("b")), f"{work}/linked")
    nodes = classes.drop("vec").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(names, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    result = keyed.drop("vec").join(nodes, ["h1", "h2"]).select("vec_id", "n_links", F.col("component_id"))
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
