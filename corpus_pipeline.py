"""The corpus pipeline: five stages, each an operator of ``lakeseek.llm`` over all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakeseek.llm import mixing, ngram_join, packing, pii, quality
from lakeseek.llm.common import read, remove, shared_folder


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that importance resampling does not draw (6)."""
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def by_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (2)."""
    return ngram_join.keep_one(docs)


def by_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal identifiers and secrets by their kinds (9)."""
    return pii.redact(docs)


def by_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts over-represented sources to their target weights (8)."""
    return mixing.keep(docs)


def by_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document, with its text, in a training sequence (4)."""
    return packing.pack(docs, text=True)


STAGES = [("quality", by_quality), ("near_copies", by_ngram_join), ("pii", by_pii), ("mixing", by_mixing), ("packing", by_packing)]

#: Gumbel noise and the rounding of a linear program have no SQL; tests/llm/test_bruteforce.py compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again.

    The result has the final texts, cut into pieces, with the place of each. The table of a stage is deleted when the next one is written;
    that of the last stage stays, as the result reads it. Rows with null ids or texts, repeated rows and empty tables are treated as
    each operator states; an empty table gives an empty result.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            remove(spark, last)
        last = path
    return docs
