"""Incremental indexing as a stream: micro-batches of rows merged last-writer-wins into Parquet.

Rows are kept in buckets by the hash of their keys; a batch rewrites the buckets that it has rows for and links the others by name in its
manifest, so its work follows the batch, not the whole snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.vector import upsert

BUCKETS = 64


def _manifest(spark: SparkSession, folder: str, before: int) -> tuple[int, dict[int, str]]:
    """The newest batch below a number that was written to its end, and where its buckets lie."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return -1, {}
    found = [int(n) for x in fs.listStatus(at) if (n := x.getPath().getName().removeprefix("v=")).isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    last = max((n for n in found if n < before), default=-1)
    return last, {r.bucket: r.path for r in spark.read.parquet(f"{folder}/manifest/v={last}").collect()} if last >= 0 else {}  # at most BUCKETS rows


def snapshot(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows after a batch, the last one by default."""
    last, held = _manifest(spark, folder, 1 << 62 if version is None else version + 1)
    if not held:
        raise FileNotFoundError(folder)
    return spark.read.parquet(*held.values()).drop("_bucket")


def index_stream(stream: DataFrame, folder: str, keys: Sequence[str], checkpoint: str, order: str | None = None, buckets: int = BUCKETS):
    """Each batch makes the next version; repeating a batch gives the same one. Of rows with equal keys in a batch the greatest by ``order`` counts, then by all columns."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ties = [F.to_json(F.struct(*batch.columns)).desc()]
        best = W.partitionBy(*keys).orderBy(*([F.desc(order)] if order else []), *ties)
        fresh = batch.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]
        _, held = _manifest(spark, folder, number)
        old = [held[b] for b in touched if b in held]
        rows = upsert(spark.read.parquet(*old), fresh, keys) if old else fresh
        path = f"{folder}/v={number}"
        rows.repartition("_bucket").withColumn("bucket", F.col("_bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)
        held |= {b: f"{path}/bucket={b}" for b in touched}
        spark.createDataFrame(sorted(held.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/v={number}")
        fresh.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
