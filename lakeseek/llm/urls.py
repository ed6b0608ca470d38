"""URL filter by a character language-model ratio.

Two variable-order Markov models over the bytes of a URL, one of accepted and one of rejected URLs, each interpolate orders 0 to
``ORDER``: ``P_o = (n(context, byte) + a P_{o-1}) / (n(context) + a)``. A context of ``ORDER`` bytes with its byte fits a long, so
every count is exact and lives in a shuffled table that grows with the input; nothing of the model is broadcast. The score is the
log-likelihood difference per byte; a logistic curve fitted on held-out URLs (of one in five, by hash, the first
``calibration_rows`` distinct ones) turns it into the probability of acceptance. All other labelled URLs are counted.

Where a table has no verdicts, ``seed_verdicts`` gives them: a URL whose host has a word of ``REJECTED_WORDS`` is rejected.

Defined cases: a null or empty URL has score 0, probability 1/2 and is kept; a null id stays null; repeated
rows count each and are decided alike; without verdicts of both kinds every URL is kept with score 0; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import FOLDED, U, pieces, text_buffer

ORDER = 5
BITS = 9
SMOOTHING = 1.5
CALIBRATION_ROWS = 20_000
REJECTED_WORDS = ("spam", "casino", "pills", "adult", "xxx", "porn", "bets", "poker", "viagra", "track", "malware", "phish")


def seed_verdicts(url: Column) -> Column:
    """1 accepted, 0 rejected: by words of the host."""
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z]+://)?([^/?#]*)", 1))
    return (~host.rlike(f"(^|[^a-z])({'|'.join(REJECTED_WORDS)})($|[^a-z])")).cast("int")


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each byte (and each URL's end): the byte with the ``ORDER`` before it, ``BITS`` each, the byte lowest; and the row."""
    raw, off = text_buffer(column)
    n = np.diff(off)
    # ORDER zero bytes before each URL and one end sign after it
    at = np.arange(len(raw)) + np.repeat(np.arange(len(n)) * (ORDER + 1) + ORDER, n)
    size = len(raw) + len(n) * (ORDER + 1)
    x = np.zeros(size, U)
    x[at] = FOLDED[raw]
    ends = off[1:] + np.arange(1, len(n) + 1) * (ORDER + 1) - 1
    x[ends] = U(300)
    mine = np.concatenate([at, ends])
    row = np.concatenate([np.repeat(np.arange(len(n)), n), np.arange(len(n))])
    some = n[row] > 0
    mine, row = mine[some], row[some]
    g = np.zeros(len(mine), U)
    for o in range(ORDER, -1, -1):
        g = (g << U(BITS)) | x[mine - o]
    return g.astype(np.int64), row


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "url"):
        g, row = grams(b.column("url"))
        each, place = np.unique(g, return_inverse=True)
        n = [np.bincount(place, weights=b.column(c).to_numpy()[row], minlength=len(each)).astype(np.int64) for c in ("n0", "n1")]
        yield pa.record_batch([pa.array(each), *map(pa.array, n)], ["gram", "n0", "n1"])


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "url"):
        g, row = grams(b.column("url"))
        yield pa.record_batch([pa.array(b.column("id").to_numpy()[row]), pa.array(g)], ["id", "gram"])


def ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log-likelihood difference, accepted less rejected, of each gram of ``counts`` (gram, n0, n1)."""
    below = None
    for o in range(ORDER + 1):
        of = Window.partitionBy(F.shiftright("gram", BITS))  # at most as many rows as there are bytes
        each = counts.groupBy(F.col("gram").bitwiseAND(F.lit((1 << BITS * (o + 1)) - 1)).alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        each = each.withColumns({"c0": F.sum("n0").over(of), "c1": F.sum("n1").over(of)})
        if below is None:
            each = each.withColumns({"q0": F.lit(1 / 257), "q1": F.lit(1 / 257)})
        else:
            each = each.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << BITS * o) - 1))).join(below, "shorter")
        p = [((F.col(f"n{c}") + SMOOTHING * F.col(f"q{c}")) / (F.col(f"c{c}") + SMOOTHING)).alias(f"q{c}") for c in (0, 1)]
        below = each.select(F.col("gram").alias("shorter"), *p)
    return below.select(F.col("shorter").alias("gram"), (F.log(F.greatest("q1", F.lit(1e-12))) - F.log(F.greatest("q0", F.lit(1e-12)))).alias("ratio"))


def calibrate(score: np.ndarray, verdict: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of P(accepted | score), both classes weighing the same; Newton with a small ridge. count: times that each counts."""
    y = verdict.astype(float)
    if not count[y > 0].any() or not count[y == 0].any():
        return 1.0, 0.0
    n = count.sum()
    share = count[y > 0].sum() / n
    weight = count * np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    x = np.stack([score, np.ones_like(score)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) / n + 1e-4 * b
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / n + 1e-4 * np.eye(2)
        b = b - np.linalg.solve(h, g)
    return float(b[0]), float(b[1])


def filter_urls(pages: DataFrame, verdict: Column | None = None, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """(page_id, url, score, p_accept, keep) of every row. verdict: a column of ``pages``, 1 or 0 or null; else ``seed_verdicts``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    given = pages.select("url", (seed_verdicts(F.col("url")) if verdict is None else verdict).cast("int").alias("verdict")).where("url <> ''")
    each = given.groupBy("url").agg(F.count_if(F.col("verdict") == 0).alias("v0"), F.count_if(F.col("verdict") == 1).alias("v1"))
    each = cut(each.withColumns({"id": F.monotonically_increasing_id(), "h": F.xxhash64(F.lit(5), "url"), "held": (F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(5)) == 0) & (F.col("v0") + F.col("v1") > 0)}))
    last = each.where("held").select("h").orderBy("h").limit(calibration_rows).agg(F.max("h")).first()[0]
    sampled = F.col("held") & (F.col("h") <= F.lit(last)) if last is not None else F.lit(False)
    n = {f"n{c}": F.when(sampled, 0).otherwise(F.col(f"v{c}")) for c in (0, 1)}
    known = each.agg(*[F.sum(x).alias(k) for k, x in n.items()]).first()
    if not known.n0 or not known.n1:
        return rows.select("page_id", "url", F.lit(0.0).alias("score"), F.lit(1.0).alias("p_accept"), F.lit(True).alias("keep"))
    counts = each.select("url", *[x.cast("double").alias(k) for k, x in n.items()]).mapInArrow(_count, "gram long, n0 long, n1 long")
    model = ratios(cut(counts.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))))
    score = each.select("id", "url").mapInArrow(_positions, "id long, gram long").join(model, "gram").groupBy("id").agg(F.avg("ratio").alias("score"))
    scored = cut(each.join(score, "id").select("url", "score", "v0", "v1", sampled.alias("sampled")))
    got = scored.where("sampled").select("score", "v0", "v1").toPandas()
    x = got["score"].to_numpy(float)
    slope, shift = calibrate(np.tile(x, 2), np.repeat([0, 1], len(x)), np.concatenate([got["v0"].to_numpy(float), got["v1"].to_numpy(float)]))
    p = F.lit(1.0) / (1 + F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), -(F.col("score") * slope + shift)))))
    out = rows.join(scored.select("url", "score"), "url", "left").select("page_id", "url", F.coalesce("score", F.lit(0.0)).alias("score"))
    return out.withColumn("p_accept", F.when(F.coalesce(F.length("url"), F.lit(0)) == 0, 0.5).otherwise(p)).withColumn("keep", F.col("p_accept") >= 0.5)
