"""MinHash near-duplicates (operator 3): DartMinHash signatures, banded joining, exact Jaccard check.

A document's elements are its distinct shingles of five words (white-space separated, A-Z lowered; fewer words make one
shingle), each of weight one, or of the number of times it stands there if `weighted`; similarity is that of the sets, or of
the weighted sets.  Documents with equal elements and weights form one class at once, and one representative goes on.

Darts: every element owns a region of weight (0, w] by rank; hashed unit-rate Poisson darts fall on it in order of rank.
Weight beyond 1 falls in columns [2^(j-1), 2^j) with darts at that rate, kept where their weight is below the element's.
All darts up to a rank that the document's total weight sets are thrown; each falls on a coordinate, which keeps the
earliest.  Coordinates still empty get darts of higher ranks.  So a signature costs darts by the number of coordinates,
not coordinates times elements, and coordinates agree with probability equal to the (weighted) Jaccard similarity.

Joining: bands of coordinates are hashed to buckets.  For a few rounds every bucket names a leader, another each time, and
its members of other components are checked against it exactly, on the shingle sets; so a large group of copies costs
pairs in proportion to its size.  At last whatever stands outside the largest component of a bucket is checked against
everything of other components in the bucket, so no link between components is lost to the choice of leaders; for wide
buckets that is done in blocks, as _crowds() tells.  Buckets of more than SPLIT members are dealt in parts wherever rows
meet by bucket, so no task grows with one.  Two documents at a similarity of 0.8 share no bucket once in 20,000 times.

Edge cases: texts without words (null, empty, white space) are like nothing, each on its own; repeated rows are copies of
each other, and exactly one row of a group is kept, the smallest by (doc_id, row); null ids count as largest; texts of
any length are read whole; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.llm._bytes import U, mix, ragged, words
from boscage.llm._common import components, drop, forget_shuffles, local_components, scanned, shared_dir, text_slices, utf8, written

SHINGLE = 5
BANDS, ROWS = 25, 5
#: Rounds of one leader a bucket before what is left meets everything that it may be like.
TURNS = 3
#: Members of a bucket beyond which the last comparison is made in blocks, and members of a block.
WIDE, BLOCK = 64, 256
#: Members of a bucket that one part of it holds, and parts in which buckets are dealt while it isn't known which are large.
SPLIT, SPREAD = 500, 64
SIMILARITY = 0.8
ROW = "boscage_row"
#: Row numbers that may be broadcast, 16 MB of them, and pairs of them; more are joined by a shuffle.
BROADCAST, BROADCAST_PAIRS = 2_000_000, 500_000
#: Files whose names may be numbered on the driver, and bits of a row's number that tell its place in the file.
FILES, FILE_BITS = 20_000, 40


def shingles(buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, count) of the distinct shingles of each row, sorted by row and hash."""
    word, row = words(buf, rows)
    if not len(word):
        return word, row, row
    size = np.bincount(row, minlength=len(rows) - 1)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(word))  # words from here to the row's end
    first = ragged(size) == 0
    h = np.zeros(len(word), U)
    for i in range(SHINGLE):
        part = np.zeros(len(word), U)
        part[: len(word) - i] = word[i:]
        h = h * U(0x100000001B3) + np.where(left > i, mix(part + U(i + 1)), U(0))
    whole = (left >= SHINGLE) | first
    h, row = mix(h[whole]), row[whole]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
    return h[head], row[head], np.diff(np.append(head, len(h)))


def dart_minhash(element: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) signatures of the weighted sets given by elements sorted by row; a row without elements gets zeros."""
    total = np.bincount(row, weights=weight, minlength=n)
    best = np.full(n * k, np.inf)
    dart = np.zeros(n * k, U)
    # columns of the weight axis; for weight 1 there is one
    owner, column = np.arange(len(element)), np.zeros(len(element), np.int64)
    j = 1
    while (more := weight[: len(element)] > 2 ** (j - 1)).any():
        owner, column = np.append(owner, np.flatnonzero(more)), np.append(column, np.full(int(more.sum()), j))
        j += 1
    seed = mix(element[owner] + column.astype(U) * U(0x9E3779B97F4A7C15))
    rate = np.where(column == 0, 1.0, 2.0 ** (column - 1))
    rank, index = np.zeros(len(owner)), np.zeros(len(owner), np.int64)
    limit = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    of = row[owner]
    live = np.arange(len(owner))
    while len(live):
        # the next dart of each region: an exponential gap, a coordinate and a weight from its hash
        h = mix(seed[live] + index[live].astype(U) * U(0xD1342543DE82EF95))
        at = rank[live] - np.log1p(-(h >> U(11)).astype(np.float64) / 2.0**53) / rate[live]
        fell = at <= limit[of[live]]
        hit, when, h2 = live[fell], at[fell], mix(h[fell] + U(1))
        rank[hit], index[hit] = when, index[hit] + 1
        base = np.where(column[hit] == 0, 0.0, rate[hit])
        inside = base + rate[hit] * ((mix(h2) >> U(11)).astype(np.float64) / 2.0**53) < weight[owner[hit]]
        place = of[hit[inside]] * k + (h2[inside] % U(k)).astype(np.int64)
        when, h2 = when[inside], h2[inside]
        order = np.argsort(-when, kind="stable")
        place, when, h2 = place[order], when[order], h2[order]
        if len(place):
            # of several darts on a coordinate the earliest stands last and is the one that stays
            low = np.full(n * k, np.inf)
            low[place] = when
            own = np.zeros(n * k, U)
            own[place] = h2
            better = low < best
            best[better], dart[better] = low[better], own[better]
        live = hit
        if not len(live):
            short = (best.reshape(n, k) == np.inf).any(1) & (total > 0)
            if short.any():
                limit = np.where(short, limit * 2, -1.0)
                live = np.flatnonzero(short[of])
    return dart.reshape(n, k)


def copies(h: np.ndarray, row: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) with an element for each time a shingle stands in its row: sets of these are as alike as the weighted sets."""
    n = ragged(count)
    h = np.repeat(h, count)
    return np.where(n > 0, mix(h + n.astype(U) * U(0x9E3779B97F4A7C15)), h), np.repeat(row, count)


def _sketch(weighted: bool):
    """Rows of (doc_id, row id parts, set hash, bands) of texts with words; bands are null for those without."""

    def run(batches):
        for batch in text_slices(batches):
            h, row, count = shingles(*utf8(batch.column(2)))
            n = batch.num_rows
            sig = dart_minhash(h, row, count.astype(np.float64) if weighted else np.ones(len(h)), n, BANDS * ROWS)
            bands = np.zeros((n, BANDS), U)
            for b in range(BANDS):
                x = np.full(n, b + 1, U)
                for r in range(ROWS):
                    x = mix(x * U(0x100000001B3) + sig[:, b * ROWS + r])
                bands[:, b] = x
            if weighted:
                h, row = copies(h, row, count)
            size = np.bincount(row, minlength=n)
            one, two = (np.zeros(n, U) for _ in range(2))
            np.add.at(one, row, mix(h + U(17)))
            np.add.at(two, row, mix(h ^ U(0xABCDEF0123456789)))
            none = size == 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(none, 0, BANDS))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(one.view(np.int64), mask=none), pa.array(two.view(np.int64), mask=none), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(bands[~none].ravel().view(np.int64)))],
                ["rid", "doc_id", "h1", "h2", "size", "bands"],
            )

    return run


def _sets(weighted: bool):
    def run(batches):
        for batch in text_slices(batches):
            h, row, count = shingles(*utf8(batch.column(1)))
            if weighted:
                h, row = copies(h, row, count)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], ["node", "shingles"])

    return run


def _jaccard(batches):
    for batch in batches:
        out = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
            if 10 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
                out.append(min(len(x), len(y)) / max(len(x), len(y)))  # an upper bound, far below every threshold in use
                continue
            both = len(x) + len(y) - len(np.union1d(x, y))
            out.append(both / max(1, len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "j"])


def _checked(pairs: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """(a, b, j): the exact Jaccard similarity of the pairs (a, b) of nodes, written.

    Few pairs are brought to the sets, so that only the sets of pairs move; many are joined by shuffles.
    """
    pairs = written(pairs, f"{path}_pairs")
    few = pairs.count() <= BROADCAST_PAIRS
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    if few:
        right = right.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    both = left.join(F.broadcast(pairs) if few else pairs, "a").join(right, "b")
    checked = written(both.select("a", "b", "x", "y").mapInArrow(_jaccard, "a long, b long, j double"), path)
    drop(pairs.sparkSession, f"{path}_pairs")
    return checked


def _crowds(wide: DataFrame, sets: DataFrame, similarity: float, work: str) -> DataFrame:
    """Links (a, b) of members of wide buckets, compared in blocks: tasks tell components, never pairs.

    What stands outside a bucket's largest component meets all of the bucket, BLOCK by BLOCK, so that no row is made for a
    pair and sets travel once a block.
    """
    most = wide.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.max("parts").alias("parts")).groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("most"), F.sum("k").alias("k"), F.max("parts").alias("parts"))
    most = most.select("bucket", F.col("most.component").alias("most"), F.ceil(F.col("k") / BLOCK).alias("nb"), F.ceil((F.col("k") - F.col("most.k")) / BLOCK).alias("ob"), "parts").where("ob > 0")
    full = wide.drop("parts").join(_in_parts(most), ["bucket", "part"]).join(sets, "node")
    salt = F.xxhash64("node", F.lit(2))
    every = full.withColumn("j", F.pmod(salt, F.col("nb"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ob") - 1))).withColumn("asks", F.lit(False))
    asked = full.where("component <> most").withColumn("i", F.pmod(salt, F.col("ob"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).withColumn("asks", F.lit(True))
    columns = ["bucket", "i", "j", "asks", "node", "shingles"]

    def compare(key, table):
        asks = np.asarray(table["asks"])
        sides = []
        for mask in (asks, ~asks):
            part = table.filter(pa.array(mask))
            own = [np.frombuffer(x, U) for x in part["shingles"].to_pylist()]
            size = np.array([len(x) for x in own], np.int64)
            sides.append((np.asarray(part["node"]), size, np.concatenate(own) if own else np.zeros(0, U), np.repeat(np.arange(len(own)), size)))
        (an, asz, ah, ar), (bn, bsz, bh, br) = sides
        both = np.intersect1d(ah, bh)
        shared = np.zeros((len(an), len(bn)), np.float32)
        for c in range(0, len(both), 4096):
            part = both[c : c + 4096]
            m = []
            for h, r, n in ((ah, ar, len(an)), (bh, br, len(bn))):
                at = np.minimum(np.searchsorted(part, h), len(part) - 1)
                hit = part[at] == h
                x = np.zeros((n, len(part)), np.float32)
                x[r[hit], at[hit]] = 1
                m.append(x)
            shared += m[0] @ m[1].T
        shared = shared.astype(np.float64)
        links = shared >= similarity * (asz[:, None] + bsz[None] - shared)
        links &= an[:, None] != bn[None]
        al, bl = local_components(links, an, bn)
        return pa.table({"a": pa.array(np.concatenate([an, bn])), "b": pa.array(np.concatenate([al, bl]))})

    return written(every.select(*columns).unionByName(asked.select(*columns)).groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").where("a <> b").distinct(), f"{work}/crowds_linked")


def _in_parts(rows: DataFrame) -> DataFrame:
    """Rows of buckets, of `parts` parts each, once for each part."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _dealt(bucket: DataFrame, work: str) -> DataFrame:
    """(node, size, bucket, part, parts) of members of buckets that hold several; large buckets are dealt in parts."""
    counts = written(bucket.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")), f"{work}/counts")
    large = counts.where("parts > 1")
    if large.count() <= BROADCAST:
        known = bucket.join(F.broadcast(large), "bucket", "left")
    else:  # too many large buckets to tell every task: they meet their members in SPREAD parts
        spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        known = bucket.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SPREAD)).cast("int")).join(spread, ["bucket", "salt"], "left").drop("salt")
    known = known.withColumn("part", F.pmod(F.xxhash64("node", F.lit(4)), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return known.join(_in_parts(counts.withColumn("all", F.col("parts"))), ["bucket", "part"]).withColumnRenamed("all", "parts").select("node", "size", "bucket", "part", "parts")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """rid, doc_id, class_id, component_id, kept for every row of (doc_id, text).

    class_id: the smallest doc_id with the same shingles (and weights, if they count); component_id: the smallest doc_id reachable by links of
    `similarity` or more; kept: exactly one row of each component.  rid numbers the rows of the pass over docs.
    """
    return _found(*_numbered(docs.select("doc_id", "text")), similarity, weighted)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row number that a row keeps whatever becomes of executors, and a work folder.

    Rows of a file scan are numbered by file and place; others are written with a number first.
    """
    spark, work = docs.sparkSession, shared_dir(docs.sparkSession)
    if scanned(docs):
        paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().limit(FILES + 1).collect())
        if len(paths) <= FILES:
            files = spark.createDataFrame([(p, i << FILE_BITS) for i, p in enumerate(paths)], f"{ROW}_file string, {ROW}_base long")
            placed = docs.select("*", F.col("_metadata.file_path").alias(f"{ROW}_file"), F.col("_metadata.row_index").alias(f"{ROW}_place"))
            return placed.join(F.broadcast(files), f"{ROW}_file").select(*docs.columns, (F.col(f"{ROW}_base") + F.col(f"{ROW}_place")).alias(ROW)), work
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), f"{work}/numbered"), work


def _found(numbered: DataFrame, work: str, similarity: float, weighted: bool = False) -> DataFrame:
    spark = numbered.sparkSession
    rows = numbered.select(F.col(ROW).alias("rid"), "doc_id", "text")
    sketch = written(rows.mapInArrow(_sketch(weighted), "rid long, doc_id long, h1 long, h2 long, size long, bands array<long>"), f"{work}/sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("m")
    # classes of equal sets: one row each, numbered by its first row's rid
    classes = written(sketch.where("size > 0").groupBy("h1", "h2").agg(first, F.first("size").alias("size"), F.first("bands").alias("bands")).select("h1", "h2", F.col("m.rid").alias("node"), "m", "size", "bands"), f"{work}/classes")
    bucket = classes.select("node", "size", F.explode("bands").alias("bucket"))
    members = written(_dealt(bucket, work), f"{work}/members")
    forget_shuffles(spark)
    needed = written(members.select("node").distinct(), f"{work}/needed")
    if needed.count() <= BROADCAST:  # then the texts stay where they are
        needed = F.broadcast(needed)
    sets = written(rows.select(F.col("rid").alias("node"), "text").join(needed, "node").mapInArrow(_sets(weighted), "node long, shingles binary"), f"{work}/sets")
    linked = seen = None
    for turn in range(TURNS + 1):
        now = members.withColumn("component", F.col("node")) if linked is None else members.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if turn < TURNS:  # another leader for each bucket that still holds several components
            lead = F.min(F.struct(F.xxhash64("node", "bucket", F.lit(turn)), F.col("node").alias("leader"), F.col("component").alias("of"), F.col("size").alias("n"))).alias("lead")
            heads = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), lead, F.max("parts").alias("parts")).where("low <> high").select("bucket", "lead.leader", "lead.of", "lead.n", "parts")
            near = now.drop("parts").join(_in_parts(heads), ["bucket", "part"]).where("component <> of")
        else:  # what is left outside a bucket's largest component meets everything of other components in the bucket
            now = written(now, f"{work}/parted")
            most = now.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.max("parts").alias("parts")).groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("of"), F.sum("k").alias("k"), F.max("parts").alias("parts")).where("of > 1").select("bucket", F.col("most.component").alias("most"), "k", "parts")
            rest = now.drop("parts").join(_in_parts(most.where(F.col("k") <= WIDE)), ["bucket", "part"]).where("component <> most").select("bucket", F.col("node").alias("leader"), F.col("component").alias("of"), F.col("size").alias("n"))
            near = now.join(rest, "bucket").where("component <> of")
            wide = now.join(_in_parts(most.where(F.col("k") > WIDE).select("bucket", "parts")), ["bucket", "part"]).select("bucket", "node", "component", "part", "parts")
        near = near.where(F.least("size", "n") >= similarity * F.greatest("size", "n")).select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()
        if seen is not None:
            near = near.join(seen, ["a", "b"], "left_anti")
        checked = _checked(near, sets, f"{work}/checked{turn}")
        forget_shuffles(spark)
        fresh = not checked.where(F.col("j") >= similarity).isEmpty()
        seen = checked.select("a", "b", "j") if seen is None else seen.unionByName(checked)
        links = seen.where(F.col("j") >= similarity).select("a", "b")
        if turn == TURNS:
            links = links.unionByName(_crowds(wide, sets, similarity, work))
        if fresh or linked is None or turn == TURNS:
            linked = components(links, f"{work}/linked{turn}")
    for name in ("members", "counts", "needed", "sets", "parted", "crowds_linked", *(f"checked{turn}" for turn in range(TURNS + 1))):
        drop(spark, f"{work}/{name}")
    forget_shuffles(spark)
    nodes = classes.select("h1", "h2", "m", "node").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = nodes.groupBy("component").agg(F.min("m").alias("head"))
    nodes = nodes.join(heads, "component").select("h1", "h2", F.col("m.doc_id").alias("class_id"), "head")
    found = sketch.drop("bands").where("size > 0").join(nodes, ["h1", "h2"]).select("rid", "doc_id", "class_id", F.col("head.doc_id").alias("component_id"), (F.col("head.rid") == F.col("rid")).alias("kept"))
    return found.unionByName(sketch.where("size = 0").select("rid", "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def keep(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, of which one of each group of near-duplicates stays."""
    numbered, work = _numbered(docs)
    gone = written(_found(numbered, work, similarity).where("not kept").select(F.col("rid").alias(ROW)), f"{work}/gone")
    if gone.count() <= BROADCAST:
        gone = F.broadcast(gone)
    forget_shuffles(docs.sparkSession)
    return numbered.join(gone, ROW, "left_anti").select(*docs.columns)
