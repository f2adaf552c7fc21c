"""Shared plumbing: the shared folder, written tables, Arrow slicing and connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; a longer single text is handled alone.
SLICE_BYTES = 500_000
#: Rows that Spark hands to a Python worker at once while a table is written.
BATCH_ROWS = 2_000


_writing, _writers, _before = threading.Lock(), [], []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the input folder, pruned to the columns in use (extra columns never reach an operator)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; only where that is unset, and in local mode (tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="boscage-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get()
    return f"{root.rstrip('/')}/boscage-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends in files that outlive executors.

    Rows are handed to Python workers BATCH_ROWS at a time, which bounds the memory of both sides.  That is a setting of the
    session, so it is set while any such write goes on and put back after the last one: queries of one session at the same
    time share it, and it changes no result.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _writing:
        if not _writers:
            _before[:] = [spark.conf.get(name)]
            spark.conf.set(name, str(min(BATCH_ROWS, int(_before[0])) if int(_before[0]) > 0 else BATCH_ROWS))
        _writers.append(path)
    try:
        df.write.parquet(path)
    finally:
        with _writing:
            _writers.remove(path)
            if not _writers:
                spark.conf.set(name, _before[0])
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps now: it does so once the driver's objects for them are collected."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scanned(df: DataFrame) -> bool:
    """Whether df is rows of one file scan, each at most once and alike in every pass, so that (file, row index) names a row."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic() or "_metadata" in (c.lower() for c in df.columns):
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    try:
        return "row_index" in df.select("_metadata").schema[0].dataType.names
    except AnalysisException:
        return False


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate (file sizes for scans); where it knows none, or multiplies, the bytes of the texts are added up."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known < 1 << 50:
        return known
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def remainder(key: Column | str, modulus: int) -> Column:
    """crc32(key as text) mod modulus; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about `limit` bytes of text, and one row at least."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.diff(_offsets(col)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give freed memory back to the system: after each partition of a worker that lives on, and after training."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def _offsets(col: pa.Array):
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def utf8(col: pa.Array):
    """(bytes, row offsets) of a string array without copying; a null is an empty text."""
    import numpy as np

    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = _offsets(col)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def components(edges: DataFrame, work: str) -> DataFrame:
    """(node, component): the smallest node reachable by the undirected edges (a, b), for every node with an edge.

    Alternating large-star and small-star rounds (Kiveris et al. 2014).  Each round is two aggregations with map-side
    combine and two equi-joins whose skewed keys AQE splits; rounds are written to the shared folder, and the driver
    sees nothing but two checksums a round.  Nulls and self-links are ignored.
    """
    spark = edges.sparkSession
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last, before, n = written(now, f"{work}/cc0"), f"{work}/cc0", None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, n = state, n + 1
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: every edge points down; hang the node and its lower neighbours on the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = written(small, f"{work}/cc{n}")
        drop(spark, last)
        last = f"{work}/cc{n}"
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def local_components(links, q, m):
    """The smallest node of each query's and member's component in a block's link matrix."""
    import numpy as np

    big = np.iinfo(np.int64).max
    while True:
        low = np.minimum(m, np.where(links, q[:, None], big).min(0, initial=big))
        new = np.minimum(q, np.where(links, low[None], big).min(1, initial=big))
        if (low == m).all() and (new == q).all():
            return q, m
        q, m = new, low
