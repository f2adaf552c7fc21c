"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


#: The estimate in bytes from which a checkpoint forgets it.
LARGEST = 2**62


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() to the shared folder of spark.checkpoint.dir; where none is set, in local mode only (tests), to one of our own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="boscage-"))
    return _resized(df.checkpoint())


def _resized(df: DataFrame) -> DataFrame:
    """The checkpoint without the size that was estimated for the plan behind it, once that passes 2^62 bytes.

    A checkpoint keeps the estimate, and a join multiplies those of its sides: in a loop the number's length doubles every
    round, until planning it takes all of the driver's memory.  Rows and partitioning stay as they are.
    """
    own = df._jdf.logicalPlan()
    if int(own.stats().sizeInBytes()) < LARGEST:
        return df
    jvm = df.sparkSession.sparkContext._jvm
    none, session = jvm.scala.Option.empty(), df.sparkSession._jsparkSession
    plain = jvm.org.apache.spark.sql.execution.LogicalRDD(own.output(), own.rdd(), own.outputPartitioning(), own.outputOrdering(), False, none, session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plain), df.sparkSession)
