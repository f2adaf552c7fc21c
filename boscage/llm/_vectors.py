"""Vectors: reading Arrow lists into matrices, validity, bounded samples and k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that an index is fitted on, at most (documented bound); every vector is indexed.
SAMPLE = 8_192


def matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their vectors in double precision) of the valid vectors: `width` finite components, not all zero."""
    size = np.asarray(pc.fill_null(pc.list_value_length(col), -1))
    rows = np.flatnonzero(size == width)
    if not len(rows) or not width:
        return np.zeros(0, np.int64), np.zeros((0, max(width, 1)))
    flat = col.take(pa.array(rows)).flatten().cast(pa.float64())
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    with np.errstate(invalid="ignore", over="ignore"):
        good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def valid(table: DataFrame, path: str) -> tuple[DataFrame, int]:
    """(rid, vec_id, vec) written to `path`, vec being the vector's doubles or null where it takes no part; the width.

    The width is the most common length in the table; vectors of other lengths take no part.
    """
    from boscage.llm._common import written

    sizes = table.where("embedding is not null").groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = int(sizes["w"]) if sizes else 0

    def run(batches):
        for b in batches:
            rows, x = matrix(b.column(2), width)
            out: list = [None] * b.num_rows
            for r, v in zip(rows.tolist(), x, strict=True):
                out[r] = v.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["rid", "vec_id", "vec"])

    numbered = table.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "embedding")
    return written(numbered.mapInArrow(run, "rid long, vec_id long, vec binary"), path), width


def stacked(col: pa.Array, width: int, kind: np.dtype | type = np.float64) -> np.ndarray:
    """The matrix, in double precision, of a binary column of doubles (or of another kind of number)."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros((0, width))
    return np.frombuffer(b"".join(col.to_pylist()), kind).astype(np.float64, copy=False).reshape(-1, width)


def sample(vectors: DataFrame, n: int, width: int, bound: int = SAMPLE) -> np.ndarray:
    """At most `bound` vectors, chosen by a hash of their row."""
    share = min(1.0, (bound - 4 * bound**0.5) / max(1, n))
    t = vectors.where(F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000).select("rid", "vec").limit(bound).toArrow().sort_by("rid")
    return stacked(t["vec"], width)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, balance: float = 0.0, seed: int = 3) -> np.ndarray:
    """Centroids of Lloyd rounds over a bounded sample; with balance, large clusters repel in the next assignment."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    if not len(x):
        return np.zeros((1, x.shape[1]))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    load = np.zeros(k)
    for _ in range(rounds):
        d = distances(x, c)
        if balance:
            d = d + balance * d.mean() * np.minimum(load, 4.0)
        own = d.argmin(1)
        count = np.bincount(own, minlength=k)
        load = np.maximum(count * k / len(x) - 1, 0)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            c[empty] = x[rng.choice(len(x), len(empty))]
    return c
