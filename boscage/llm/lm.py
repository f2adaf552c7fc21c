"""Language-model scoring (operator 8): an interpolated modified Kneser-Ney n-gram model of a whole corpus.

Counted in Spark, stored as sorted hash arrays in the shared folder, memory-mapped by the workers that score.

1. words    every slice of texts is tokenised on its flat bytes and pre-aggregated to (word hash, count); shards by hash
            range merge them.  A word's rank, first by the magnitude of its count and then by hash, is its number from then
            on: so frequent words have small numbers, which blobs keep in few bytes.
2. n-grams  (words before, word) as tuples of ranks, pre-aggregated per task; shards merge them and store the sorted 64-bit
            hashes of the tuples with their counts.  Each shard also tells, of every tuple without its last word, how much
            follows it, and of every tuple without its first, before how many distinct words it stands.
3. lower    these tell the counts of the next shorter n-grams, merged in the same way down to single words.
4. score    workers map the arrays and look up a slice's distinct n-grams by binary search.

A shard holds the tuples whose words before have a hash in its range.  Where these words are all so frequent that what
follows them could outgrow a shard, tuples are dealt by their own hash, so no shard grows with one tuple or word.  Shards
take a bounded share of the input, so their number grows with it and the work of a task doesn't.  Only a row of totals
per shard reaches the driver.  Blobs are sorted ranks stored as deltas in byte planes, compressed.  A repeated task writes
the same bytes under the same name.

P(w|u) = max(c(uw)-D_c(uw),0)/c(u) + g(u) P'(w|u'), u' being u without its first word, P' counting distinct words before
instead of occurrences; the words' own level leaves one share for unknown words.  Where u was never seen, P(w|u) is
P'(w|u').  Discounts are Chen and Goodman's, from each level's counts of counts.  Texts begin after order - 1 begin signs.
Counts are exact up to 2**63; tuples are counted by 64-bit hashes of their ranks.  Stored hashes are sorted, in buckets by
their first bits with 40 more of each kept; the numbers of a tuple are an entry in its shard's list of distinct ones.

Edge cases: null and empty texts are one end token; texts of any length are counted and scored whole; an empty training
set gives the uniform distribution over one unknown word; repeated rows count as often as they stand; null ids count as
the empty text in the fold; extra columns are not read.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
import zlib
from collections import OrderedDict
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscage.llm._bytes import U, mix, ragged, words
from boscage.llm._common import forget_shuffles, release, input_bytes, shared_dir, text_slices, utf8

#: The words of an n-gram unless the caller says otherwise.
ORDER = 3
#: The hash that stands for the end of a text.
END = U(0)
#: Stored bytes of input for each shard, at least and at most (between them 4,096 shards), and tokens that a task holds.
SHARD_BYTES, SHARD_MOST, HOLD = 4 << 20, 16 << 20, 2_000_000
#: Tuples of a bucket on average.
BUCKET = 16
#: Bytes that a worker keeps of a store that can't be mapped; beyond it what was used longest ago goes.
FETCHED = 256 << 20
#: What is stored of a tuple: its own count, then the sum and the numbers of ones, twos and larger counts that follow it.
FIELDS = ("c", "total", "n1", "n2", "n3")


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit whole numbers, the first sorted and kept as deltas, in byte planes.

    Planes of zeros take no room, and planes whose first bytes don't shrink are kept as they are.
    """
    out = [len(columns[0]).to_bytes(8, "little"), len(columns).to_bytes(8, "little")]
    for i, column in enumerate(columns):
        column = np.asarray(column).astype(U, copy=False)
        planes = (np.diff(column, prepend=U(0)) if i == 0 else np.ascontiguousarray(column)).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            plane = np.ascontiguousarray(planes[:, j])
            if not plane.any():
                out.append(bytes(4))
                continue
            plane = plane.tobytes()
            tried = plane[:4096]
            small = zlib.compress(plane, 1) if len(zlib.compress(tried, 1)) < 0.95 * len(tried) else plane
            out += [len(small).to_bytes(4, "little"), small] if len(small) < len(plane) else [(1 << 31 | len(plane)).to_bytes(4, "little"), plane]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns, each in the narrowest unsigned type."""
    n, k, at = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little"), 16
    out = []
    for i in range(k):
        planes = []
        for _ in range(8):
            size = int.from_bytes(blob[at : at + 4], "little")
            at += 4
            bare, size = size >> 31, size & ((1 << 31) - 1)
            part = blob[at : at + size]
            planes.append(np.frombuffer(part if bare or not size else zlib.decompress(part), np.uint8) if size else None)
            at += size
        last = max((j for j, x in enumerate(planes) if x is not None), default=0)
        width = next(w for w in (1, 2, 4, 8) if last < w)
        full = np.zeros((n, width), np.uint8)
        for j, x in enumerate(planes[:width]):
            if x is not None:
                full[:, j] = x
        column = full.view(f"<u{width}").ravel()
        if i == 0:
            column = np.cumsum(column, dtype=U)
            column = column.astype(np.min_scalar_type(int(column[-1]) if n else 0), copy=False)
        out.append(column)
    return out


def _pieces(blobs: list) -> list[np.ndarray]:
    parts = [unpack(b) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def grouped(keys: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct sorted keys, the place of one of each, their summed columns)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), sums
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[head], order[head], [np.add.reduceat(s[order], head, dtype=np.int64) for s in sums]


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of each tuple of ranks; that of its first words is a step on the way."""
    h = mix(columns[0].astype(U) + U(1))
    for c in columns[1:]:
        h = mix(h * U(0x100000001B3) + c.astype(U) + U(1))
    return h


def _files(folder: str):
    """(local path or None, Arrow file system, path) of a folder; None where workers have to go through Arrow."""
    at = urlparse(folder)
    if at.scheme in ("", "file"):
        return at.path, None, at.path
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    return None, store, path


def save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Write arrays, each in its narrowest type, end to end under a final name at once.

    A repeated task or a second attempt writes a draft of its own and then the same bytes.
    """
    local, store, path = _files(folder)
    arrays = [a.astype(np.min_scalar_type(int(a.max(initial=0))), copy=False) for a in arrays]
    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], "<i8")
    data = b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in (head, *arrays))
    draft = f"{local or path}/.{name}.{uuid.uuid4().hex}"
    if local:
        os.makedirs(local, exist_ok=True)
        with open(draft, "wb") as f:
            f.write(data)
        os.replace(draft, f"{local}/{name}")
        return
    from pyarrow import fs

    store.create_dir(path, recursive=True)
    with store.open_output_stream(draft) as f:
        f.write(data)
    try:
        store.move(draft, f"{path}/{name}")
    except OSError:  # a store that doesn't overwrite: another attempt was first
        if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            raise
        store.delete_file(draft)


_maps: OrderedDict[str, tuple[int, list[np.ndarray]]] = OrderedDict()


def mapped(folder: str, name: str) -> list[np.ndarray]:
    """Arrays of the shared folder, memory-mapped; of a store that can't be mapped a bounded number is held in memory."""
    key = f"{folder}/{name}"
    if key in _maps:
        _maps.move_to_end(key)
        return _maps[key][1]
    local, store, path = _files(folder)
    if local:
        with open(f"{local}/{name}", "rb") as f:
            try:  # without a descriptor of its own for each of many shards
                held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
            except TypeError:
                held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with store.open_input_stream(f"{path}/{name}") as f:
            held = f.read()
    out, at = [], 8
    for size, n in np.frombuffer(held, "<i8", 2 * int(np.frombuffer(held, "<i8", 1)[0]), 8).reshape(-1, 2).tolist():
        at = at if out else 8 + 16 * int(np.frombuffer(held, "<i8", 1)[0])
        out.append(np.frombuffer(held, f"<u{size}", n, at))
        at += n * size + -(n * size) % 8
    weight = 0 if local else len(held)
    while _maps and (len(_maps) >= 20_000 or weight + sum(x for x, _ in _maps.values()) > FETCHED):
        _maps.popitem(last=False)
    _maps[key] = (weight, out)
    return out


def _turned(keys: np.ndarray, bits: int) -> np.ndarray:
    """The hashes with the bits that may have chosen the shard moved to the end."""
    return (keys << U(bits)) | (keys >> U(64 - bits)) if bits else keys


def _entries(values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(entry of each row, the entries' columns): rows of small numbers are told apart by a table, others by sorting."""
    each = 20 // len(values)
    small = np.logical_and.reduce([v < 1 << each for v in values])
    key = sum((v * small) << (each * i) for i, v in enumerate(values))
    used = np.flatnonzero(np.bincount(key[small], minlength=1))
    number = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
    number[used] = np.arange(len(used))
    code = number[np.minimum(key, len(number) - 1)]
    large = np.flatnonzero(~small)
    _, first, back = np.unique(chained([v[large] for v in values]), return_index=True, return_inverse=True)
    code[large] = len(used) + back
    return code, [np.append((used >> (each * i)) & ((1 << each) - 1), v[large[first]]) for i, v in enumerate(values)]


def stored(keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Arrays to save of tuples by their sorted turned hashes: buckets' ends, 32 and 8 bits of each hash, entry, entries."""
    m = max(1, (len(keys) // BUCKET).bit_length())
    ends = np.searchsorted(keys, np.append(np.arange(1, 1 << m).astype(U) << U(64 - m), U(2**64 - 1)), "left")
    ends[-1] = len(keys)
    code, entries = _entries(values)
    return [ends, ((keys >> U(32 - m)) & U(0xFFFFFFFF)).astype(np.uint32), ((keys >> U(24 - m)) & U(0xFF)).astype(np.uint8), code, *entries]


def looked_up(arrays: list[np.ndarray], keys: np.ndarray) -> list[np.ndarray]:
    """The numbers of each turned hash among what `stored` made of a shard, zeros where it isn't there."""
    ends, high, low, code, *entries = arrays
    m = (len(ends) - 1).bit_length()
    bucket = (keys >> U(64 - m)).astype(np.int64)
    want = ((keys >> U(32 - m)) & U(0xFFFFFFFF)).astype(np.uint32)
    end = ends[bucket].astype(np.int64)
    at = np.where(bucket > 0, ends[bucket - 1], 0).astype(np.int64)
    step = 1 << int((end - at).max(initial=0)).bit_length()
    while step := step >> 1:  # binary search in all buckets at once
        ahead = at + step
        at = np.where((ahead <= end) & (high[np.minimum(ahead, len(high)) - 1] < want), ahead, at)
    spot = np.minimum(at, len(high) - 1)
    hit = (at < end) & (high[spot] == want) & (low[spot] == ((keys >> U(24 - m)) & U(0xFF)).astype(np.uint8))
    of = code[spot]
    return [np.where(hit, e[of], 0).astype(np.int64) for e in entries]


@dataclass
class Words:
    """The sorted word hashes, counts and places in shards of hash range; bits: shards as a power of two.

    sizes: words of each magnitude of count (largest first) and shard, in which order they are ranked.
    """

    folder: str
    bits: int
    sizes: np.ndarray

    def __post_init__(self):
        self.base = np.concatenate([[0], np.cumsum(self.sizes.ravel())]).astype(np.int64)
        self.full = self.sizes.sum(0)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks, counts) of sorted distinct hashes; -1 and 0 where unknown."""
        rank, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for s, a, b in _runs(_range(hashes, self.bits)):
            if n := int(self.full[s]):
                own, times, place = mapped(self.folder, f"w{s}")
                at = np.minimum(np.searchsorted(own, hashes[a:b].astype(own.dtype)), n - 1)
                hit = own[at] == hashes[a:b]
                count[a:b] = np.where(hit, times[at], 0)
                rank[a:b] = np.where(hit, self.base[_magnitude(times[at]) * len(self.full) + s] + place[at], -1)
        return rank, count

    def owner(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, place among the shard's words by rank) of ranks; the begin sign is the last shard's last."""
        n = len(self.full)
        box = np.minimum(np.searchsorted(self.base, ranks, "right") - 1, self.sizes.size - 1)
        shard = np.where(ranks >= self.base[-1], n - 1, box % n)
        before = (np.cumsum(self.sizes, 0) - self.sizes).ravel()
        return shard, np.where(ranks >= self.base[-1], self.full[n - 1], before[box] + ranks - self.base[box])


#: Magnitudes of counts, the largest first.
MAGNITUDES = 64


def _magnitude(count: np.ndarray) -> np.ndarray:
    return (MAGNITUDES - 1 - np.floor(np.log2(np.maximum(count.astype(np.float64), 1)))).astype(np.int64)


def _range(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _runs(sorted_shards: np.ndarray):
    """(shard, begin, end) of the runs of a sorted array."""
    if not len(sorted_shards):
        return
    head = np.flatnonzero(np.append(True, sorted_shards[1:] != sorted_shards[:-1]))
    yield from zip(sorted_shards[head].tolist(), head.tolist(), np.append(head[1:], len(sorted_shards)).tolist(), strict=True)


def _tokens(batch: pa.RecordBatch, at: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of a batch's words with an end token after each text's last."""
    word, row = words(*utf8(batch.column(at)))
    word = np.where(word == END, U(1), word)
    stop = np.searchsorted(row, np.arange(batch.num_rows), "right")
    return np.insert(word, stop, END), np.insert(row, stop, np.arange(batch.num_rows))


def _windows(rank: np.ndarray, row: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """The columns of each token's n-gram: order - 1 words before it, `begin` before the text's first, and itself."""
    place = ragged(np.bincount(row))
    return [np.where(place >= k, np.concatenate([np.full(min(k, len(rank)), begin), rank[: max(0, len(rank) - k)]]), begin) for k in range(order - 1, 0, -1)] + [rank]


def _shard(columns: list[np.ndarray], often: list[np.ndarray], bits: int) -> np.ndarray:
    """The shard of each tuple: by its first words, or by all where the first are all frequent."""
    before = chained(columns[:-1])
    hot = np.logical_and.reduce(often)
    return _range(np.where(hot, mix(before * U(0x100000001B3) + columns[-1].astype(U) + U(1)), before), bits)


def _blobs(shard: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray], top: int) -> pa.RecordBatch:
    """A row (shard, blob) for each shard, its tuples sorted by their first word; `top`: the largest rank."""
    wide, most = int(top).bit_length(), int(shard.max(initial=0)).bit_length()
    first = columns[0].astype(U)
    if len(columns) > 1 and 2 * wide + most <= 64:  # the second word's order only makes blobs smaller
        order = np.argsort((shard.astype(U) << U(2 * wide)) | (first << U(wide)) | columns[1].astype(U))
    elif wide + most <= 64:
        order = np.argsort((shard.astype(U) << U(wide)) | first if wide < 64 else first)
    else:
        order = np.lexsort((first, shard))
    shard, columns, values = shard[order], [c[order] for c in columns], [v[order] for v in values]
    runs = list(_runs(shard))
    blobs = [pack(*(c[a:b] for c in columns), *(v[a:b] for v in values)) for _, a, b in runs]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in runs], pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(len(runs), pa.string())], schema=ROWS)


ROWS = pa.schema([("shard", pa.int32()), ("blob", pa.binary()), ("note", pa.string())])
SQL_ROWS = "shard int, blob binary, note string"


def _counted(batches, columns_of, flush):
    """Hold columns over slices of texts and hand them on, time and again."""
    held, size = [], 0
    for batch in text_slices(batches):
        held.append(columns_of(batch))
        size += len(held[-1][0])
        if size >= HOLD:
            yield flush([np.concatenate(c) for c in zip(*held, strict=True)])
            held, size = [], 0
    if held:
        yield flush([np.concatenate(c) for c in zip(*held, strict=True)])


@dataclass
class Level:
    """The stored tuples of one length: shards' sizes, discounts, and for single words their sums."""

    sizes: np.ndarray
    discounts: tuple = (0.0, 0.5, 0.5, 0.5)
    total: int = 0
    ones: tuple = (0, 0, 0)


@dataclass
class Model:
    words: Words
    order: int
    share: int
    levels: dict[int, Level] = field(default_factory=dict)
    tokens: int = 0
    texts: int = 0

    @property
    def vocabulary(self) -> int:
        return int(self.words.base[-1])


def _discounts(n: list[int]) -> tuple[float, float, float, float]:
    """Discounts of counts 0, 1, 2 and above from the numbers of keys seen once to four times."""
    n1, n2, n3, n4 = (max(float(x), 0.0) for x in n)
    if not (n1 and n2):
        return (0.0, 0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return (0.0, *(float(min(max(x, 0.05), i + 0.95)) for i, x in enumerate(d)))


def _counts_of(count: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(count, 5).astype(np.int64), minlength=6)[1:5].tolist()


def _bits(total: int) -> int:
    """Shards, as a power of two, for so many bytes of input."""
    each = min(SHARD_MOST, max(SHARD_BYTES, total >> 12))
    return (max(4, -(-total // each)) - 1).bit_length()


def train(docs: DataFrame, allowed: Column, order: int = ORDER) -> Model:
    """Count the texts of the rows that fulfil `allowed` and store the model's arrays in the shared folder."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    folder = shared_dir(spark)
    spark.range(1).write.parquet(f"{folder}/made")
    texts = docs.where(allowed).select("doc_id", "text")
    bits = _bits(input_bytes(docs))
    shards = 1 << bits
    tasks = max(min(shards, 128), shards // 8)
    dealt = lambda rows: rows.repartition(tasks, "shard").groupBy("shard")

    def to_words(batches):
        def flush(columns):
            keys, _, (count,) = grouped(columns[0], [np.ones(len(columns[0]), np.int64)])
            return _blobs(_range(keys, bits), [keys], [count], (1 << 64) - 1)

        return _counted(batches, lambda b: [_tokens(b)[0]], flush)

    def store_words(key, table):
        s = key[0].as_py()
        keys, counts = _pieces(table["blob"].to_pylist())
        keys, _, (counts,) = grouped(keys.astype(U, copy=False), [counts])
        magnitude = _magnitude(counts)
        order = np.argsort(magnitude, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[order] = ragged(np.bincount(magnitude))
        save(folder, f"w{s}", [keys, counts, place])
        release()
        note = {"n": np.bincount(magnitude, minlength=MAGNITUDES).tolist(), "tokens": int(counts.sum()), "stops": int(counts[keys == END].sum())}
        return pa.Table.from_arrays([pa.array([s], pa.int32()), pa.nulls(1, pa.binary()), pa.array([json.dumps(note)])], schema=ROWS)

    sizes, tokens, stops = np.zeros((MAGNITUDES, shards), np.int64), 0, 0
    for r in dealt(texts.mapInArrow(to_words, SQL_ROWS)).applyInArrow(store_words, SQL_ROWS).select("shard", "note").collect():
        note = json.loads(r["note"])
        sizes[:, r["shard"]] = note["n"]
        tokens, stops = tokens + note["tokens"], stops + note["stops"]
    forget_shuffles(spark)
    model = Model(Words(folder, bits, sizes), order, max(1, tokens >> bits), {}, tokens, stops)
    begin = model.vocabulary
    narrow = np.int32 if begin < 1 << 31 else np.int64
    held = spark.sparkContext.broadcast(model)

    def to_tuples(batches):
        own = held.value

        def columns_of(batch):
            hashes, row = _tokens(batch)
            word, index = np.unique(hashes, return_inverse=True)
            rank, _ = own.words.find(word)
            hot = frequent(own, np.append(rank, begin))
            columns = _windows(rank.astype(narrow)[index], row, order, narrow(begin))
            place = _windows(index, row, order, len(word))
            return [*columns, np.logical_and.reduce([hot[p] for p in place[:-1]])]

        def flush(columns):
            *columns, hot = columns
            _, at, (count,) = grouped(chained(columns), [np.ones(len(hot), np.int64)])
            columns = [c[at] for c in columns]
            return _blobs(_shard(columns, [hot[at]], bits), columns, [count], begin)

        return _counted(batches, columns_of, flush)

    def store(level):
        """Merge a shard's tuples of `level` words, store them, and tell the shorter ones."""

        def run(key, table):
            own, s = held.value, key[0].as_py()
            notes = [x for x in table["note"].to_pylist() if x is not None]
            blobs = [x for x in table["blob"].to_pylist() if x is not None]
            out = [pa.RecordBatch.from_arrays([pa.array([s] * len(notes), pa.int32()), pa.nulls(len(notes), pa.binary()), pa.array(notes, pa.string())], schema=ROWS)]
            if not blobs:
                return pa.Table.from_batches(out, schema=ROWS)
            parts = _pieces(blobs)
            keys, at, values = grouped(_turned(chained(parts[:level]), bits), parts[level:])
            columns = [c[at] for c in parts[:level]]
            del parts, blobs
            n = len(keys)
            if level > 1:
                save(folder, f"g{level}_{s}", stored(keys, values))
            else:  # a place for every word of the shard, and in the last for the begin sign
                n = int(own.words.full[s]) + (s == shards - 1)
                full = [np.zeros(n, np.int64) for _ in values]
                for f, v in zip(full, values, strict=True):
                    f[own.words.owner(columns[0].astype(np.int64))[1]] = v
                save(folder, f"g1_{s}", full)
            count = values[0]
            note = {"level": level, "shard": s, "n": n, "seen": _counts_of(count), "total": int(count.sum()), "more": int((count > 2).sum())}
            out.append(pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.nulls(1, pa.binary()), pa.array([json.dumps(note)], pa.string())], schema=ROWS))
            real = count > 0
            if level > 1 and real.any():
                columns, count = [c[real] for c in columns], count[real]
                none, one = np.zeros(len(count), np.int64), np.ones(len(count), np.int64)
                few = np.minimum(count, 3)
                follow = [none, count, *((few == i).astype(np.int64) for i in (1, 2, 3))]
                shorter = [np.concatenate(x) for x in zip(columns[:-1], columns[1:], strict=True)]
                _, at, sums = grouped(chained(shorter), [np.concatenate(x) for x in zip(follow, [one, none, none, none, none], strict=True)])
                shorter = [c[at] for c in shorter]
                if level > 2:
                    hot = [frequent(own, c) for c in shorter[:-1]]
                    shard = _shard(shorter, hot, bits)
                else:
                    shard = own.words.owner(shorter[0].astype(np.int64))[0]
                out.append(_blobs(shard, shorter, sums, begin))
                del columns, values, sums, shorter, follow
            release()
            return pa.Table.from_batches(out, schema=ROWS)

        return run

    rows = texts.mapInArrow(to_tuples, SQL_ROWS)
    for level in range(order, 0, -1):
        rows = dealt(rows).applyInArrow(store(level), SQL_ROWS)
    notes: dict[int, list] = {k: [] for k in range(1, order + 1)}
    for r in rows.where("note is not null").select("note").collect():
        note = json.loads(r["note"])
        notes[note["level"]].append(note)
    for level, own in notes.items():
        sizes, seen = np.zeros(shards, np.int64), np.zeros(4, np.int64)
        for x in own:
            sizes[x["shard"]] = x["n"]
            seen += x["seen"]
        model.levels[level] = Level(sizes, _discounts(seen.tolist()), sum(x["total"] for x in own), (int(seen[0]), int(seen[1]), sum(x["more"] for x in own)))
    held.unpersist()
    forget_shuffles(spark)
    return model


def frequent(model: Model, ranks: np.ndarray) -> np.ndarray:
    """Whether each word, or the begin sign, is of a magnitude that may exceed a shard's share of the tokens."""
    least = model.words.base[(int(_magnitude(np.array([model.share]))[0]) + 1) * len(model.words.full)]
    return np.where(ranks == model.vocabulary, model.texts > model.share, ranks < least)


def _found(model: Model, level: int, keys: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
    """The stored numbers of each tuple, zeros where unknown."""
    own, bits = model.levels[level], model.words.bits
    keys = _turned(keys, bits)
    order = np.argsort((shard.astype(U) << U(64 - bits)) | (keys >> U(bits)) if bits else keys)
    keys, shard = keys[order], shard[order]
    out = [np.zeros(len(keys), np.int64) for _ in range(1 if level == model.order else len(FIELDS))]
    for s, a, b in _runs(shard):
        if own.sizes[s]:
            for o, v in zip(out, looked_up(mapped(model.words.folder, f"g{level}_{s}"), keys[a:b]), strict=True):
                o[order[a:b]] = v
    return out


def _single(model: Model, ranks: np.ndarray) -> list[np.ndarray]:
    """The stored numbers of distinct words by rank, the begin sign included."""
    out = [np.zeros(len(ranks), np.int64) for _ in FIELDS]
    shard, place = model.words.owner(ranks)
    order = np.argsort(shard, kind="stable")
    for s, a, b in _runs(shard[order]):
        if model.levels[1].sizes[s]:
            for o, v in zip(out, mapped(model.words.folder, f"g1_{s}"), strict=True):
                o[order[a:b]] = v[place[order[a:b]]]
    return out


def _score(model: Model, batch: pa.RecordBatch) -> list[pa.Array]:
    hashes, row = _tokens(batch)
    n, begin, order = batch.num_rows, model.vocabulary, model.order
    word, index = np.unique(hashes, return_inverse=True)
    rank, count = model.words.find(word)
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (begin + 1)))
    numbers = [np.zeros(len(word) + 1, np.int64) for _ in FIELDS]  # of each word, and of the begin sign
    know = np.append(rank >= 0, True)
    for o, v in zip(numbers, _single(model, np.append(rank[rank >= 0], begin)), strict=True):
        o[know] = v
    low = model.levels[1]
    if low.total:
        e = np.array(low.discounts)
        before = numbers[0][:-1]
        left = sum(x * y for x, y in zip(low.discounts[1:], low.ones, strict=True)) / low.total
        p = (np.maximum(before - e[np.minimum(before, 3)], 0) / low.total + left / (begin + 1))[index]
    else:
        p = np.full(len(index), 1 / (begin + 1))
    place = ragged(np.bincount(row, minlength=n))
    spot = _windows(index, row, order, len(word))
    columns = [np.append(rank, begin)[x] for x in spot]
    hot = frequent(model, np.append(rank, begin))
    # what follows each token's last words; the entry behind the last is that of begin signs alone
    after = [np.append(v[index], v[-1]) for v in numbers]
    for level in range(2, order + 1):
        own = [np.append(c, begin) for c in columns[order - level :]]
        warm = np.logical_and.reduce([np.append(hot[x], hot[-1]) for x in spot[order - level : -1]])
        ok = np.logical_and.reduce([c >= 0 for c in own])
        picked = [c[ok] for c in own]
        found = [np.zeros(len(ok), np.int64) for _ in range(1 if level == order else len(FIELDS))]
        for o, v in zip(found, _found(model, level, chained(picked), _shard(picked, [warm[ok]], model.words.bits)), strict=True):
            o[ok] = v
        d = np.array(model.levels[level].discounts)
        from_here = np.where(place > 0, np.arange(len(index)) - 1, len(index))
        total, few = after[1][from_here], [after[i][from_here] for i in (2, 3, 4)]
        seen = found[0][:-1]
        spread = sum(d[i + 1] * f for i, f in enumerate(few))
        p = np.where(total > 0, (np.maximum(seen - d[np.minimum(seen, 3)], 0) + spread * p) / np.maximum(total, 1), p)
        after = found
    add = lambda x: pa.array(np.bincount(row, weights=x, minlength=n))
    whole = lambda x: pa.array(np.bincount(row, weights=x, minlength=n).astype(np.int64))
    return [whole(np.ones(len(row))), whole((count > 0)[index]), pa.array(np.full(n, model.tokens)), add(base[index]), add(np.log10(p))]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): logarithms of probabilities to the base ten."""
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers a shard

    def run(batches):
        for b in text_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *_score(held.value, b)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
