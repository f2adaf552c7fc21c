"""Best-fit packing (operator 2): pieces of documents into as few sequences of bounded length as possible.

Method: hierarchical residual packing.  Every partition best-fits its own items, longest first, and emits the bins that
are nearly full; the others go up a tree, eight groups to one, as items of the next best-fit round.  The allowance for
"nearly full" grows fourfold a level, and a best-fit chunk leaves one bin of half the capacity or less at most, so the
number of bins that reach the root is bounded by the number of chunks, never by the number of documents.
Bins carry their members' keys and lengths, not token ids; each level is a written table.

Edge cases: null and empty texts hold the end token alone; a text longer than the capacity is cut into full pieces and a
rest; ties and repeated rows are packed each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.llm._bytes import ragged
from boscage.llm._common import shared_dir, written
from boscage.llm.bpe import encode_batches

FAN_IN = 8
#: Items that one best-fit holds in memory.
CHUNK = 200_000
MEMBERS = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
BINS = pa.schema([("grp", pa.int64()), ("sequence_id", pa.int64()), ("fill", pa.int64()), ("done", pa.bool_()), *((k, pa.list_(t)) for k, t in MEMBERS.items())])
SQL_BINS = "grp long, sequence_id long, fill long, done boolean, doc_id array<long>, piece array<int>, start array<long>, length array<long>, ids_crc32 array<long>"


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, longest items first, each into the fullest bin that has room.

    Bins stand in stacks by their room; an integer's bits say which stacks hold any, so a search is one shift.
    """
    if len(lengths) and (lengths.max() > capacity or lengths.min() < 0):
        raise ValueError(f"items must hold 0 to {capacity} tokens")
    out = np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            found = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, found, bins = capacity, bins, bins + 1
        out[i] = found
        left = room - size
        if not stacks[left]:
            rooms |= 1 << left
        stacks[left].append(found)
    return out


def _packed(table: pa.Table | pa.RecordBatch, fills: np.ndarray, sizes: np.ndarray, flat: dict, capacity: int, level: int, grp: int, at: int, last: bool) -> pa.RecordBatch:
    """Pack items (of `sizes` members each, flat holds the members end to end) and make a row for each bin."""
    own = best_fit(fills, capacity)
    order = np.argsort(own, kind="stable")
    n = int(own.max()) + 1 if len(own) else 0
    begin = np.cumsum(sizes) - sizes
    take = np.repeat(begin[order], sizes[order]) + ragged(sizes[order])
    counts = np.bincount(own, weights=sizes, minlength=n).astype(np.int64)
    fill = np.bincount(own, weights=fills, minlength=n).astype(np.int64)
    slack = min(capacity, (capacity // 256) * 4**level)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, flat[k].take(pa.array(take))) for k in MEMBERS]
    done = (capacity - fill <= slack) | last
    ids = (level << 58) | (grp << 29) | (at + np.arange(n))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, grp)), pa.array(ids), pa.array(fill), pa.array(done), *lists], schema=BINS)


def pieces(batches, path: str, capacity: int, end: int):
    """Arrow batches of (doc_id, piece, start, length, ids_crc32): tokenised texts, an end token each, cut to capacity."""
    for batch, ids, counts in encode_batches(batches, path):
        ids = np.insert(ids, np.cumsum(counts), end).astype("<u4")
        counts = counts + 1
        n = -(-counts // capacity)
        piece = ragged(n)
        start = piece * capacity
        length = np.minimum(capacity, np.repeat(counts, n) - start)
        begin = np.repeat(np.cumsum(counts) - counts, n) + start
        raw = memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
        docs = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
        yield pa.RecordBatch.from_arrays([docs, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(crc, np.int64))], list(MEMBERS))


def _first(path: str, capacity: int, end: int):
    def run(batches):
        grp = TaskContext.get().partitionId()
        held, count, at = [], 0, 0

        def flush(last: bool = False):
            t = pa.Table.from_batches(held)
            fills = np.asarray(t["length"])
            flat = {k: t[k].combine_chunks() for k in MEMBERS}
            return _packed(t, fills, np.ones(len(fills), np.int64), flat, capacity, 0, grp, at, last)

        for b in pieces(batches, path, capacity, end):
            held.append(b)
            count += b.num_rows
            if count >= CHUNK:
                out = flush()
                yield out
                held, count, at = [], 0, at + out.num_rows
        if held:
            yield flush()

    return run


def _again(capacity: int, level: int, last: bool):
    def run(key, table):
        grp, at, out = key[0].as_py(), 0, []
        for b in table.combine_chunks().to_batches(max_chunksize=CHUNK):
            flat = {k: b.column(b.schema.get_field_index(k)).flatten() for k in MEMBERS}
            sizes = np.diff(np.asarray(b.column(b.schema.get_field_index("doc_id")).offsets)).astype(np.int64)
            out.append(_packed(b, np.asarray(b.column(b.schema.get_field_index("fill"))), sizes, flat, capacity, level, grp, at, last))
            at += out[-1].num_rows
        return pa.Table.from_batches(out, schema=BINS)

    return run


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of (doc_id, text)."""
    spark = docs.sparkSession
    work = shared_dir(spark)
    bins = written(docs.select("doc_id", "text").mapInArrow(_first(path, capacity, end), SQL_BINS), f"{work}/level0")
    levels, level = [bins.where("done")], 0
    groups = (bins.agg(F.max("grp")).first()[0] or 0) + 1
    open_bins = bins.where("not done")
    while True:
        level += 1
        groups = -(-groups // FAN_IN)
        last = groups == 1
        packed = open_bins.withColumn("grp", F.expr(f"grp div {FAN_IN}")).groupBy("grp").applyInArrow(_again(capacity, level, last), SQL_BINS)
        bins = written(packed, f"{work}/level{level}")
        levels.append(bins.where("done"))
        if last:
            break
        open_bins = bins.where("not done")
    whole = levels[0]
    for x in levels[1:]:
        whole = whole.unionByName(x)

    def flat(batches):
        for b in batches:
            lists = b.column(0)
            counts = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            cols = [b.column(i).flatten() for i in range(len(MEMBERS))]
            length = np.asarray(cols[3])
            total = np.cumsum(length) - length
            heads = np.cumsum(counts) - counts
            offset = total - np.repeat(total[heads], counts) if len(length) else total
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.repeat(np.asarray(b.column(5)), counts)), pa.array(offset)], [*MEMBERS, "sequence_id", "offset"])

    return whole.select(*MEMBERS, "sequence_id").mapInArrow(flat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
