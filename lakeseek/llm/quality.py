"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of the target texts and one of all raw texts, give every document the log
ratio of its likelihoods. Gumbel noise, fixed by the document's id, is added and the k largest keys are the sample: sampling
without replacement in proportion to the importance weights. The sample's size is a share that is asked for, or the expected number of
documents of the target: the sum over all documents of the probability of being good, by a logistic curve over the log ratio that is
fitted on labelled documents.

Features of a text, all hashed into ``BUCKETS``: white-space tokens as written, pairs of neighbours (a token that repeats its
predecessor has one bucket for all tokens), and the shape of each token's ends. The raw model counts every document; the
target model counts the texts of at most ``target_rows`` labelled documents.

Defined cases: a null or empty text has log ratio 0; a null id counts as id 0 for the noise; repeated rows are decided alike;
without target labels every log ratio is 0; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_value, cut, fresh, label_sample, uniform
from .tokens import EXACT, SOLID, U, ids, mix, ngrams, pieces, rows_of, text_buffer, tokens

BUCKETS = 1 << 14
TARGET_ROWS = 20_000
_KIND = np.full(256, 0, np.uint8)
_KIND[:] = np.arange(256)
_KIND[48:58] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[128:] = 4


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every feature of the texts."""
    raw, off = text_buffer(column)
    t, s, e, index = tokens(raw, off, SOLID, EXACT)
    if not len(t):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = rows_of(index)
    pair, at, pair_row = ngrams(t, index, 2, short=False)
    pair = np.where(t[at] == t[at + 1], U(0x5EED), pair)
    shape = _KIND[raw[s]].astype(U) * U(1 << 16) + _KIND[raw[np.maximum(e - 2, s)]].astype(U) * U(256) + _KIND[raw[e - 1]].astype(U)
    h = np.concatenate([t, mix(pair + U(1)), mix(shape + U(1 << 40))])
    return (h & U(BUCKETS - 1)).astype(np.int64), np.concatenate([row, pair_row, row])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros((2, BUCKETS), np.int64)
    for b in pieces(batches, "text"):
        bucket, row = features(b.column("text"))
        target = np.asarray(b.column("_target").to_numpy(zero_copy_only=False), bool)
        table[0] += np.bincount(bucket, minlength=BUCKETS)
        table[1] += np.bincount(bucket[target[row]], minlength=BUCKETS)
    used = np.flatnonzero(table[0])
    yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(table[0][used]), pa.array(table[1][used])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """log p_target - log p_raw for each bucket, with add-one smoothing; counts are summed over all documents."""
    target = label_sample(labels.where("quality = 1"), "quality", target_rows).select(F.col("doc_id").alias("_id"), F.lit(True).alias("_target"))
    marked = docs.select("doc_id", "text").join(F.broadcast(target), F.col("doc_id") == F.col("_id"), "left").select("text", F.coalesce("_target", F.lit(False)).alias("_target"))
    counts = marked.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, aim = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[counts.bucket] += counts.raw
    aim[counts.bucket] += counts.target
    if counts.empty or counts.target.sum() == 0:
        return np.zeros(BUCKETS)
    return np.log(aim / aim.sum()) - np.log(raw / raw.sum())


def with_key(docs: DataFrame, ratio: np.ndarray, seed: int, log_ratio: str = "log_ratio", key: str = "gumbel_key") -> DataFrame:
    """``docs`` with the log ratio and the key (log ratio plus Gumbel noise) in columns of these names."""
    shared = broadcast_value(docs.sparkSession, ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            bucket, row = features(b.column("text"))
            value = np.bincount(row, weights=shared.value[bucket], minlength=b.num_rows).astype(float)  # of no features, bincount makes integers
            noise = -np.log(-np.log(uniform(ids(b), seed)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(value), pa.array(value + noise)], [*b.schema.names, log_ratio, key])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(log_ratio, T.DoubleType()), T.StructField(key, T.DoubleType())]))


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096, small: int = 4096) -> float:
    """The k-th largest value of a column without a sort: histograms over ever narrower ranges, then the few rows left."""
    col = F.col(column)
    lo, hi, n = keys.agg(F.min(col), F.max(col), F.count(col)).first()
    if n == 0 or k <= 0:
        return float("inf")
    if k >= n:
        return float("-inf")
    while n > small and hi > lo:
        width = (hi - lo) / bins
        if lo + width <= lo:
            break
        inside = keys.where((col >= lo) & (col <= hi))
        hist = inside.groupBy(F.least(F.lit(bins - 1), F.floor((col - lo) / width)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"))
        for r in sorted(hist.collect(), key=lambda r: -r.bin):
            if k <= r.n:
                lo, hi, n = r.lo, r.hi, r.n
                break
            k -= r.n
    if lo == hi:
        return lo
    # at most ``small`` rows, or values so close that fewer than ``bins`` numbers lie between: each value once
    for r in keys.where((col >= lo) & (col <= hi)).groupBy(col.alias("v")).count().orderBy(F.desc("v")).collect():
        if k <= r["count"]:
            return r.v
        k -= r["count"]
    raise AssertionError("the counts do not add up")


def posterior(log_ratio: np.ndarray, good: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept of P(good | log ratio), by Newton on the log loss with a small ridge; the ratio in units of its spread."""
    x = np.stack([log_ratio, np.ones_like(log_ratio)], 1)
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        g = x.T @ (p - good) / len(good) + 1e-4 * b
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x / len(good) + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        b = b - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
    return float(b[0]), float(b[1])


def expected_good(scored: DataFrame, labels: DataFrame, rows: int) -> int | None:
    """How many documents belong to the target by expectation: the sum over all of P(good | log ratio).

    The curve is fitted on at most ``rows`` labelled documents; None without both labels. Noise and keys play no part.
    """
    known = label_sample(labels, "quality", rows).select(F.col("doc_id").alias("_id"), "label")
    got = scored.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("log_ratio", "label").toPandas()
    good = (got.label > 0).to_numpy(float)
    if not len(got) or good.all() or not good.any():
        return None
    spread = float(np.median(np.abs(got.log_ratio))) or 1.0
    slope, shift = posterior(got.log_ratio.to_numpy() / spread, good)
    z = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col("log_ratio") * (slope / spread) + shift))
    return round(scored.agg(F.sum(1 / (1 + F.exp(-z)))).first()[0])


def threshold(docs: DataFrame, labels: DataFrame, keep_fraction: float | None = None, seed: int = 6, target_rows: int = TARGET_ROWS) -> tuple[np.ndarray, float, DataFrame]:
    """The model, the key of the last sampled document and the checkpointed keys of all documents."""
    ratio = fit(docs, labels, target_rows)
    scored = cut(with_key(docs.select("doc_id", "text"), ratio, seed).select("doc_id", "log_ratio", "gumbel_key"))
    k = expected_good(scored, labels, target_rows) if keep_fraction is None else round(keep_fraction * scored.count())
    return ratio, float("-inf") if k is None else kth_largest(scored, "gumbel_key", k), scored


def resample(docs: DataFrame, labels: DataFrame, keep_fraction: float | None = None, seed: int = 6, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The sampled documents as (doc_id, log_ratio, gumbel_key), the k largest keys.

    k is ``keep_fraction`` of the rows; when that is None, the number of documents that belong to the target by expectation. Rows tied
    with the last key are kept; without both labels, all.
    """
    _, last, scored = threshold(docs, labels, keep_fraction, seed, target_rows)
    return scored.where(F.col("gumbel_key") >= last)


def keep(docs: DataFrame, labels: DataFrame, keep_fraction: float | None = None, seed: int = 6, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``docs`` without the rows that are not sampled; every column stays. The score is taken again, which moves no text."""
    ratio, last, _ = threshold(docs, labels, keep_fraction, seed, target_rows)
    log_ratio, key = fresh(docs.columns, "_log_ratio"), fresh(docs.columns, "_key")
    return with_key(docs, ratio, seed, log_ratio, key).where(F.col(key) >= last).select(*docs.columns)
