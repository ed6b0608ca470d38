"""Packing by cutting-stock column generation.

Texts are cut into pieces of at most ``CAPACITY`` tokens; full pieces fill a bin alone. The other lengths, rounded up to
``QUANTUM`` tokens, form a histogram. A linear program over packing patterns covers it with the fewest bins: a revised simplex
holds the basis, and a knapsack dynamic program over the duals prices the next pattern until none improves. Patterns are rounded
down, the few pieces left of each length are packed by first-fit decreasing over the classes, and every pattern takes the next
ranks of its lengths. Ranks come from counts by length and range of the hash, so nothing is sorted as a whole. The histogram and the
program have a fixed size (``CAPACITY / QUANTUM`` lengths), whatever the input.

Defined cases: a null, empty or blank text has no tokens and gives no piece; a null id is packed with id null; repeated rows are
pieces of their own, told apart by an arbitrary order; equal lengths are taken in order of the id's hash,
then id, at every input size; a long text gives several pieces;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as counting

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, cut
from .mixing import token_table
from .tokens import SOLID, pieces as text_pieces, text_buffer

CAPACITY = 2048
QUANTUM = 16
SLICE_ROWS = 200_000


def best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of the greatest total value within the room."""
    best = np.zeros(room + 1)
    choice = np.full(room + 1, -1)
    useful = np.flatnonzero(value > 1e-12)
    for c in range(1, room + 1):
        best[c], choice[c] = best[c - 1], -1
        fit = useful[sizes[useful] <= c]
        if len(fit):
            got = value[fit] + best[c - sizes[fit]]
            k = int(np.argmax(got))
            if got[k] > best[c] + 1e-12:
                best[c], choice[c] = got[k], fit[k]
    pattern = np.zeros(len(sizes), np.int64)
    c = room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[room]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns (patterns) and their amounts in the optimum of the linear program; exactly covers the demand."""
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)  # each length alone, as often as it fits
    amount = demand / (room // sizes)
    for turn in counting():
        if turn > 1000 * m:  # never seen; a wrong optimum is not passed on in silence
            raise ArithmeticError("column generation goes in a circle")
        dual = np.linalg.solve(basis.T, np.ones(m))
        value, pattern = best_pattern(dual, sizes, room)
        if value <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, pattern.astype(float))
        up = direction > 1e-9
        ratio = np.where(up, amount / np.where(up, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        step = max(float(ratio[out]), 0.0)
        amount = np.maximum(amount - step * direction, 0)
        amount[out] = step
        basis[:, out] = pattern
    return np.rint(basis).astype(np.int64), amount


def plan(counts: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: pieces}, bins) that take every piece of the histogram exactly once."""
    left = {s: n for s, n in counts.items() if n > 0}
    if not left:
        return []
    sizes = np.array(sorted(left), np.int64)
    columns, amount = solve(sizes, np.array([left[s] for s in sizes], float), room)
    out: list[tuple[dict[int, int], int]] = []
    for k in np.argsort(-amount):
        bins = int(np.floor(amount[k] + 1e-9))
        pattern = {int(s): int(a) for s, a in zip(sizes, columns[:, k]) if a}
        if bins > 0 and pattern:
            bins = min(bins, *(left[s] // a for s, a in pattern.items()))
            if bins > 0:
                out.append((pattern, bins))
                for s, a in pattern.items():
                    left[s] -= a * bins
    # what rounding leaves: at most a bin for each pattern, first fit decreasing, whole runs of equal bins at a time
    while any(left.values()):
        pattern, space = {}, room
        for s in sorted((s for s in left if left[s]), reverse=True):
            a = min(left[s], space // s)
            if a:
                pattern[s] = int(a)
                space -= a * s
        bins = min(left[s] // a for s, a in pattern.items())
        out.append((pattern, int(bins)))
        for s, a in pattern.items():
            left[s] -= a * bins
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, quantum: int = QUANTUM, text: bool = False) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bin_id, slot): where each piece of each document goes; with text, its characters too."""
    room = capacity // quantum
    # in place of the source, which packing does not need: 128 bits that tell rows of other ids or texts apart
    key = F.concat_ws("-", F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(9), "text", "doc_id"))
    slim = token_table(docs.select("doc_id", "text", key.alias("source"))).where("n_tokens > 0").withColumnRenamed("source", "text_key")
    pieces = slim.select("doc_id", "text_key", "h", "n_tokens", F.explode(F.expr(f"sequence(0L, cast((n_tokens - 1) div {capacity} as bigint))")).alias("piece"))
    pieces = pieces.select("doc_id", "text_key", "h", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
    pieces = pieces.withColumn("size", F.ceil(F.col("n_tokens") / quantum).cast("int"))
    rows = slim.count()
    slices = max(1, -(-rows // SLICE_ROWS))
    pieces = cut(pieces.withColumn("slice", F.least(F.lit(slices - 1), F.floor(F.col("h") / 2.0**48 * slices)).cast("int")))  # ranges of h, which has 48 bits, so the order is the same with any number
    held = cut(pieces.groupBy("size", "slice").agg(F.count("*").alias("n")))
    counts = {r["size"]: r["n"] for r in held.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    ranges, base = [], 0
    taken = dict.fromkeys(counts, 0)
    for pattern, bins in plan(counts, room):
        slot = 0
        for s, a in sorted(pattern.items(), reverse=True):
            ranges.append((s, taken[s], taken[s] + a * bins, a, base, slot))
            taken[s] += a * bins
            slot += a
        base += bins
    fixed = docs.sparkSession.createDataFrame(ranges, "size int, lo long, hi long, per long, base long, at long")
    offset = held.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    # a length of one slice is at most SLICE_ROWS pieces or so: the ranks need no sort of a whole length
    ranked = pieces.withColumn("r", F.row_number().over(W.partitionBy("size", "slice").orderBy("h", "doc_id", "piece"))).join(broadcast_if(offset), ["size", "slice"])
    ranked = ranked.withColumn("rank", F.col("r") - 1 + F.col("before"))
    placed = ranked.join(F.broadcast(fixed), "size").where("rank >= lo and rank < hi")  # fixed has at most (lengths + patterns) * lengths rows
    slot_of = (F.col("at") + (F.col("rank") - F.col("lo")) % F.col("per")).cast("int")
    placed = placed.select("doc_id", "text_key", "piece", "first_token", "n_tokens", (F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).cast("long").alias("bin_id"), slot_of.alias("slot"))
    if not text:
        return placed.drop("text_key")
    mine = placed.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("piece", "first_token", "n_tokens", "bin_id", "slot"))).alias("places"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), "text").dropDuplicates(["text_key"])
    return texts.join(mine, "text_key").select("doc_id", "text", "places").mapInArrow(_cut_texts, "doc_id long, piece long, first_token long, n_tokens int, bin_id long, slot int, text string")


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each place, with the text from its first token up to the first one of the next piece."""
    for b in text_pieces(batches, "text"):
        raw, off = text_buffer(b.column("text"))
        solid = SOLID[raw]
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        at = off[:-1][off[:-1] < len(raw)]
        start[at] = solid[at]
        first = np.flatnonzero(start)
        index = np.searchsorted(first, off)
        places = b.column("places")
        flat = places.flatten()
        row = np.repeat(np.arange(b.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
        token, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("first_token", "n_tokens"))
        lo = np.where(token == 0, off[row], first[np.minimum(index[row] + token, len(first) - 1)])
        end = index[row] + token + n
        hi = np.where(end >= index[row + 1], off[row + 1], first[np.minimum(end, len(first) - 1)])
        body = [raw[i:j].tobytes().decode("utf-8") for i, j in zip(lo, hi)]
        yield pa.record_batch([b.column("doc_id").take(pa.array(row)), *[flat.field(k) for k in ("piece", "first_token", "n_tokens", "bin_id", "slot")], pa.array(body, pa.string())], ["doc_id", "piece", "first_token", "n_tokens", "bin_id", "slot", "text"])
