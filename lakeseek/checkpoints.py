"""Cutting of lineage: reliable checkpoints in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows are written to ``spark.checkpoint.dir``, shared by all executors, so that they survive the loss of any; a local folder only for a local master."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="lakeseek-checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)
