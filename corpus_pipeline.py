"""A training-corpus pipeline over `documents`: quality, language, near-duplicates, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All stages but the last return the columns of documents.

Every stage works on all rows of its input: null and empty texts, very long ones, repeated rows, null ids, empty tables and
extra columns have the results that its docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boscage.llm import langid, minhash, packing, quality
from boscage.llm._common import shared_dir, table, written
from boscage.llm.queries import CAPACITY, END_TOKEN, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; it learns from the labelled rows.

    Null and empty texts get the intercept's score, texts of any length are scored whole, repeated rows score alike and stay
    or go together, a null id changes nothing; without labels the score is 0.5 and all stay; no rows give no rows.  Extra
    columns, whatever their names, are kept.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), F.lit(True))
    return quality.keep(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identifier accepts with calibrated confidence.

    Null, empty and letterless texts are rejected; texts of any length are read whole; repeated rows stay or go together;
    null languages are not learnt, and without any all is rejected; no rows give no rows; extra columns are kept.
    """
    return langid.keep(docs, langid.train(docs, F.lit(True)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more).

    The smallest (doc_id, row) of a group stays, so of repeated rows one does; null ids count as largest; texts without
    words are like nothing and stay; texts of any length are compared whole; no rows give no rows; extra columns are kept.
    """
    return minhash.keep(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised documents' pieces placed in sequences of 4096 tokens.

    Null and empty texts are the end token alone; longer texts than a sequence are cut into full pieces and a rest; ties,
    repeated rows and null ids are packed each on their own; no rows give no rows; extra columns are not read.
    """
    return packing.pack(docs, tokenizer_path(), CAPACITY, END_TOKEN)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_dedup", near_dedup_stage), ("packing", packing_stage)]
#: Trained models and tokenisation are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written to the shared folder for the next."""
    work = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"{work}/stage{i}")
    return docs
