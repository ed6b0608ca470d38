"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 < 1 < 2 < 3 share one weight vector over hashed words; ordered thresholds part them:
``P(y > k) = sigmoid(w . x - theta_k)``. The score is the expected severity, ``sum over k of P(y > k)``.

The model is fitted on at most ``fit_rows`` labelled documents, one of each label and group of near copies (least trigram hash), so
that a text copied a thousand times is one observation. Where the labels hold grades above 1, they are the severities;
labels of 0 and 1 are graded by the number of distinct indicative words, those that labelled toxic texts hold significantly more
often than others (signed root of the likelihood ratio): a toxic text with up to one is mild, with two or three moderate, with more
severe. Features are words and the first four bytes of words of six and more. Only indicative features have a weight, so the
length of a clean text does not raise its score.

Defined cases: a null or empty text has no features and the score of the thresholds alone; a null id is scored and stays null;
repeated rows are scored alike; without labels of both classes every severity is 0; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_value, label_sample
from .tokens import FOLDED, U, distinct_by_row, lists, mix, ngrams, pieces, rows_of, text_buffer, tokens

FEATURES = 1 << 20
FIT_ROWS = 20_000
GRADES = 3
SIGNIFICANT = 5.5
PRECISION = 0.7


@dataclass
class Model:
    weights: np.ndarray
    thetas: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(y > k) for each row and k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thetas[None], -40, 40)))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, row) of every word and every word's beginning, and the least trigram hash of each row."""
    raw, off = text_buffer(column)
    t, s, e, index = tokens(raw, off)
    row = rows_of(index)
    long = np.flatnonzero(e - s >= 6)
    start = np.zeros(len(long), U)
    for k in range(4):
        start = start * U(257) + FOLDED[raw[s[long] + k]]
    g, _, g_row = ngrams(t, index, 3)
    least = np.full(len(column), 2**64 - 1, U)
    np.minimum.at(least, g_row, g)
    return np.concatenate([t, mix(start + U(1 << 50))]) & U(FEATURES - 1), np.concatenate([row, row[long]]), least


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        f, row, least = features(b.column("text"))
        f, row = distinct_by_row(f, row)
        yield pa.record_batch([b.column("label"), pa.array(least.view(np.int64)), lists(f.astype(np.int32), np.bincount(row, minlength=b.num_rows), pa.int32())], ["label", "copy", "words"])


def root_ratio(bad: np.ndarray, good: np.ndarray, share: float) -> np.ndarray:
    """Signed root of twice the log likelihood ratio of each feature's split against the overall share of toxic texts."""
    n = np.maximum(bad + good, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(bad > 0, bad * np.log(bad / (n * share)), 0) + np.where(good > 0, good * np.log(good / (n * (1 - share))), 0)
    return np.sign(bad - n * share) * np.sqrt(2 * np.maximum(g, 0))


def ordinal_fit(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, width: int, rounds: int = 400, l2: float = 1e-3, rate: float = 0.1) -> Model:
    """Adam on the negative log likelihood of the cumulative logit; thetas stay ordered by their positive steps."""
    top = int(grade.max())
    balance = len(grade) / (np.bincount(grade, minlength=top + 1)[grade] * (top + 1))
    balance = np.sqrt(balance)
    w, first, steps = np.zeros(width), 1.0, np.zeros(top - 1)
    m, v = np.zeros(width + top), np.zeros(width + top)
    for t in range(1, rounds + 1):
        theta = first + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, steps))])
        s = np.bincount(row, weights=w[feature], minlength=len(grade))
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - theta[None], -40, 40)))  # P(y > k)
        up = np.concatenate([np.ones((len(grade), 1)), p], 1)  # P(y > k - 1)
        down = np.concatenate([p, np.zeros((len(grade), 1))], 1)
        at = np.arange(len(grade))
        hi, lo = up[at, grade], down[at, grade]
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        ds = -(d_hi - d_lo) * balance
        gtheta = np.zeros(top)
        np.add.at(gtheta, grade[grade > 0] - 1, (d_hi * balance)[grade > 0])
        np.add.at(gtheta, grade[grade < top], -(d_lo * balance)[grade < top])
        gw = np.bincount(feature, weights=ds[row], minlength=width) / len(grade) + l2 * w
        gsteps = np.cumsum(gtheta[::-1])[::-1][1:] / (1 + np.exp(-steps))
        g = np.concatenate([gw, [gtheta.sum() / len(grade)], gsteps / len(grade)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, first, steps = w - move[:width], first - move[width], steps - move[width + 1 :]
    return Model(w, first + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, steps))]))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    known = label_sample(labels, "toxic", fit_rows).select(F.col("doc_id").alias("_id"), "label")
    table = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("label", "text").mapInArrow(_emit, "label int, copy long, words array<int>").toArrow()
    if table.num_rows:
        pairs = np.stack([table["copy"].to_numpy(), table["label"].to_numpy().astype(np.int64)], 1)
        table = table.take(pa.array(np.sort(np.unique(pairs, axis=0, return_index=True)[1])))
    label = np.maximum(table["label"].to_numpy(), 0) if table.num_rows else np.zeros(0, np.int64)
    if not len(label) or not (label > 0).any() or not (label == 0).any():
        return Model(np.zeros(FEATURES, np.float32), np.full(GRADES, 40.0))
    words = table["words"].combine_chunks()
    row = np.repeat(np.arange(len(label)), words.value_lengths().to_numpy())
    f = words.flatten().to_numpy()
    toxic = label > 0
    bad = np.bincount(f[toxic[row]], minlength=FEATURES)
    good = np.bincount(f[~toxic[row]], minlength=FEATURES)
    strength = root_ratio(bad, good, toxic.mean())
    marks = (strength > SIGNIFICANT) & (bad >= 4) & (bad >= PRECISION * (bad + good))
    if not marks.any():  # few labels
        marks = (strength > SIGNIFICANT / 3) & (bad >= 1)
    used = np.flatnonzero(marks)
    grade = label.astype(np.int64)
    if label.max() <= 1:
        count = np.bincount(row[marks[f]], minlength=len(label))
        grade = np.where(toxic, 1 + (count >= 2) + (count >= 4), 0)
    held = np.unique(grade)
    place = np.full(FEATURES, -1)
    place[used] = np.arange(len(used))
    inside = place[f] >= 0
    small = ordinal_fit(row[inside], place[f[inside]], np.searchsorted(held, grade), len(used))
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = small.weights
    thetas = np.full(int(grade.max()), np.nan)
    for k, theta in enumerate(small.thetas):  # a grade that no label has shares the threshold of the next
        thetas[held[k] : held[k + 1]] = theta
    return Model(weights, thetas)


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, expected_severity, grade, toxic): the mean grade, the likeliest grade, and whether that of any toxicity is above one half."""
    model = broadcast_value(docs.sparkSession, fit(docs, labels, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            f, row, _ = features(b.column("text"))
            f = f.astype(np.int64)
            hit = model.value.weights[f] != 0
            h, r = distinct_by_row(f[hit], row[hit])
            above = model.value.above(np.bincount(r, weights=model.value.weights[h], minlength=b.num_rows))
            each = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], 1)
            yield pa.record_batch([b.column("doc_id"), pa.array(above.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0] > 0.5)], ["doc_id", "expected_severity", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_severity double, grade int, toxic boolean")
