"""What the operators share: checkpoints, stable uniforms, column hygiene, bounded label samples."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's ``spark.checkpoint.dir`` is used; a local folder is made only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lakeseek-checkpoint-")
    sc.setCheckpointDir(where)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for tables written between steps."""
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are in the shared folder and survive the loss of any executor."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(taken: Iterable[str], name: str) -> str:
    """The name, with underscores added until no column has it (names are compared without case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def broadcast_value(spark: SparkSession, value):
    """A Python broadcast; only for values whose size a parameter bounds."""
    return spark.sparkContext.broadcast(value)


def broadcast_if(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A broadcast hint if the (checkpointed) table has at most ``most`` rows; else the planner's own choice of a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def label_sample(labels: DataFrame, column: str, bound: int, seed: int = 17) -> DataFrame:
    """At most ``bound`` labelled rows, those with the smallest hash of ``doc_id``: (doc_id, label).

    Rows with a null id or label are left out; of contradicting labels for one id the largest counts.
    """
    clean = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    return clean.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(bound)


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A uniform in (0, 1) for each integer id, the same on every machine."""
    from .tokens import mix

    x = mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 2 + 1))
    x = mix(x + np.uint64(0x632BE59BD9B4E019))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star: (node, component) of every node but the least of each component, which names it.

    Every round is checkpointed; the rounds needed grow with the logarithm of the longest path.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:  # until nothing changes
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("lo"))
        large = (
            both.join(low, "u")
            .select("u", "v", F.least("u", "lo").alias("m"))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        lo2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lo2, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lo2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        small = cut(small)
        same = small.exceptAll(e).isEmpty() and e.exceptAll(small).isEmpty()
        e = small
        if same:
            break
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
