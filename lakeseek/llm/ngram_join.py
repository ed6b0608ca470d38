"""N-gram Jaccard join by shared n-grams and signature trees; no pair that reaches the threshold is left out.

A document's set is the distinct 64-bit hashes of its word trigrams in lower case, letters outside ASCII too. Documents of the same set are one class
from the start.

Candidates. Every set is cut into parts by the low bits of its hashes, and the parts meet those of the other sets in buckets. There the pairs of
classes that share an n-gram of up to ``LEVELS[0]`` classes are counted; their sums over the buckets are the exact numbers of such n-grams that
the pairs share. An n-gram of more classes is hot: it is counted for each class, not for pairs. The first level sends only the n-grams below
one hash, the same for all sets, and each class counts its others as it does hot ones. Of a pair (a, b) at most the lesser of both counts is missing
from its sum, so that a pair whose sum and this bound do not make up the overlap that its sizes need does not reach the threshold.
A pair whose sum is zero has an overlap of at least ``threshold`` times either size in what is missing, so both are classes whose
count is that large. These go on with their whole sets to the next level, where the n-grams of up to ``LEVELS[1]`` of them are counted in the same way, and what is left
after the last level to a prefix filter: each is routed by its first n - ceil(threshold * n) + 1 n-grams, in an order that has those of
trees of more than ``HOT`` classes last; two sets that reach the threshold share one of these. The order decides the cost only.
The classes of a tree are chained by size.

Verification. All pairs of a connected component of candidates are compared in a dual traversal: nodes hold the OR of their members' token bitmaps
and the range of their sizes. It goes down level by level over pairs of nodes and drops a pair as soon as the greatest overlap that its bitmaps
allow is below what its size ranges need. Pairs of leaves that are left are compared by their bitmaps, then by their sets, so every reported pair is
verified. A component of up to ``2 * LEAF`` sets has no level worth a bitmap; its pairs are compared at once, with the same result. Components of
more than ``BLOCK`` classes are cut into blocks by size, and pairs of blocks, those whose size ranges allow the threshold, are
traversed as tasks of their own: memory is bounded and no pair is left out.

``groups`` gives the connected components of the similarity graph and each document's number of links, which stay linear in the input where the
pairs of a group of copies are quadratic; ``pairs`` gives every pair with its similarity.

Defined cases: rows with a null id have no identity and are left out (``keep_one`` keeps them); texts without words (null, empty, only
punctuation) have no n-grams and match nothing; one or two words are one n-gram; a repeated row counts once; of rows with one id and
different texts each takes part, the id links all that any of them reaches into one group, its links are those of all its texts, and ``keep_one``
keeps or drops them together; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, broadcast_value, components, cut, fresh
from .tokens import U, distinct_by_row, ids, lists, mix, ngrams, pieces, text_buffer, tokens

N = 3
THRESHOLD = 0.5
BLOCK = 4096
BITS = 1 << 15
LEAF = 4
#: Length of the lists of least n-grams for ``_spread`` by a number of anchors; the join itself routes by whole sets.
KEPT = 32
HOT = 512
#: By level, n-grams of more classes than this are hot.
LEVELS = (16, 128)
#: The first level leaves out this share of the n-grams, as a multiple of the threshold: below 1, so that few classes miss enough for the next level.
OUT = 0.6
#: Pairs that a bucket holds before it adds them up.
HELD = 4_000_000
#: The bitmap of classes that the executors get has 2**FILTER_BITS places, whatever their number; a class too many does no harm.
FILTER_BITS = 26
#: Up to so many n-grams of large trees are sent to the executors; beyond, they are joined. The trees are the same.
SENT = 1_000_000


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes sorted within each row, and each row's range in them."""
    raw, off = text_buffer(column)
    t, _, _, index = tokens(raw, off)
    h, _, row = ngrams(t, index, n)
    h, row = distinct_by_row(h, row)
    bounds = np.searchsorted(row, np.arange(len(column) + 1))
    return h, row, bounds


def _class(h: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: rows of the same set have the same."""
    return mix(np.add.reduceat(h, lo) + mix(np.bitwise_xor.reduceat(h, lo) + size.astype(U))).view(np.int64)


def _below(threshold: float) -> int:
    """The hash below which n-grams are sent at the first level."""
    return int((1 - OUT * threshold) * (1 << 64))


def _classes(n: int, below: int):
    """(doc_id, c, n, out): each text's class, size and number of n-grams that are not below the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            h, row, at = _sets(b.column("text"), n)
            size = np.diff(at)
            some = np.flatnonzero(size)
            if not len(some):
                continue
            out = np.bincount(row[h >= U(below)], minlength=len(size))[some]
            yield pa.record_batch([pa.array(ids(b)[some]), pa.array(_class(h, at[:-1][some], size[some])), pa.array(size[some].astype(np.int32)), pa.array(out.astype(np.int32))], ["doc_id", "c", "n", "out"])

    return run


def _summary(n: int, kept: int | None, known=None):
    """(doc_id, c, n, least): each text's class, size and ``kept`` least n-grams, of the classes of a filter if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            h, _, at = _sets(b.column("text"), n)
            size = np.diff(at)
            some = np.flatnonzero(size)
            if not len(some):
                continue
            c = _class(h, at[:-1][some], size[some])
            if known is not None:
                ok = _has(known.value, c)
                some, c = some[ok], c[ok]
            lo = at[:-1][some]
            few = size[some] if kept is None else np.minimum(size[some], kept)
            yield pa.record_batch([pa.array(ids(b)[some]), pa.array(c), pa.array(size[some].astype(np.int32)), lists(h[_ranges(lo, few)].view(np.int64), few, pa.int64())], ["doc_id", "c", "n", "least"])

    return run


def _ranges(lo: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The indices lo[k] .. lo[k] + of[k] - 1 for all k, one after another."""
    return np.repeat(lo, of) + (np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of))


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    return np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], 0)]))


def _filter(classes: DataFrame):
    """A broadcast bitmap of the classes (``c``); its size is fixed."""
    slots = classes.select(F.shiftrightunsigned("c", 64 - FILTER_BITS).alias("slot"))
    words = slots.groupBy(F.expr("slot div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("word")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return broadcast_value(classes.sparkSession, out.view(U))


def _has(known: np.ndarray, c: np.ndarray) -> np.ndarray:
    slot = c.view(U) >> U(64 - FILTER_BITS)
    return (known[(slot >> U(6)).astype(np.int64)] >> (slot & U(63)) & U(1)).astype(bool)


def _planes(x: np.ndarray) -> np.ndarray:
    """The lowest bytes of all numbers, then the next ones: of small numbers most are zeros in a row, which the shuffle compresses."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).ravel()


def _from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _fragments(n: int, buckets: int, known=None, below: int | None = None):
    """(k, c, n, of, grams): the parts of the sets in bucket k, packed. For each part its class, and in planes the size of its set and its number of n-grams; then their upper halves.

    below: only n-grams below this hash are sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            h, row, at = _sets(b.column("text"), n)
            size = np.diff(at)
            some = np.flatnonzero(size)
            if not len(some):
                continue
            c = np.zeros(len(size), np.int64)
            c[some] = _class(h, at[:-1][some], size[some])
            one = some[np.unique(c[some], return_index=True)[1]]
            keep = np.zeros(len(size), bool)
            keep[one if known is None else one[_has(known.value, c[one])]] = True
            mine = keep[row] if below is None else keep[row] & (h < U(below))
            if not mine.any():
                continue
            h, row = h[mine], row[mine]
            k = ((h & U(0xFFFFFFFF)) % U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(k, kind="stable")
            k, row, grams = k[order], row[order], (h[order] >> U(32)).astype(np.uint32)
            part = _new(k, row)
            first = _new(k[part])
            bounds, ends = np.append(first, len(part)), np.append(part[first], len(k))
            who = row[part]

            def packed(values: np.ndarray, off: np.ndarray) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

            def planes(values: np.ndarray) -> pa.Array:
                return packed(np.concatenate([_planes(values[i:j]) for i, j in zip(bounds, bounds[1:])]), 4 * bounds)

            of = np.diff(np.append(part, len(k)))
            yield pa.record_batch([pa.array(k[part[first]].astype(np.int32)), packed(c[who], bounds), planes(size[who]), planes(of), packed(grams, ends)], ["k", "c", "n", "of", "grams"])

    return run


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys with the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = _new(key)
    return key[at], np.add.reduceat(count, at)


COUNTED = "a long, b long, of int, need int"


def _counted(a: np.ndarray, b: np.ndarray, of: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(of.astype(np.int32)), pa.array(need.astype(np.int32))], ["a", "b", "of", "need"])


def _in_bucket(rows: list[tuple[bytes, ...]], limit: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """What the classes of a bucket share there: (a, b, n-grams of up to ``limit`` classes, overlap needed), and (a, a, hot n-grams, those needed to reach the threshold by them alone)."""
    c, grams = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in ((0, np.int64), (3, np.uint32)))
    n, of = (np.concatenate([_from_planes(r[i]) for r in rows]) for i in (1, 2))
    of = of.astype(np.int64)
    name, first = np.unique(c, return_index=True)  # of equal texts one
    lo, n, of = (np.cumsum(of) - of)[first], n[first].astype(np.int64), of[first]
    grams, d = grams[_ranges(lo, of)], np.repeat(np.arange(len(name)), of)
    order = np.argsort(grams, kind="stable")
    grams, d = grams[order], d[order]
    start = _new(grams)
    df = np.diff(np.append(start, len(grams)))
    hot = np.bincount(d[np.repeat(df > limit, df)], minlength=len(name))
    some = np.flatnonzero(hot)
    yield _counted(name[some], name[some], hot[some], np.ceil(threshold * n[some] - 1e-9))
    keys, counts, held = [], [], 0
    for k in range(2, limit + 1):
        at = start[df == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, HELD // len(i))
        for z in range(0, len(at), step):
            m = d[at[z : z + step, None] + np.arange(k)]
            x, y = m[:, i].ravel(), m[:, j].ravel()
            ok = (x != y) & (n[x] >= threshold * n[y] - 1e-9) & (n[y] >= threshold * n[x] - 1e-9)
            keys.append(x[ok] << 32 | y[ok])
            counts.append(np.ones(len(keys[-1]), np.int64))
            held += len(keys[-1])
            if held > HELD:
                sums = _added(keys, counts)
                keys, counts, held = [sums[0]], [sums[1]], 0
    if any(map(len, keys)):
        key, count = _added(keys, counts)
        for z in range(0, len(key), 100_000):
            x, y = key[z : z + 100_000] >> 32, key[z : z + 100_000] & 0xFFFFFFFF
            yield _counted(name[x], name[y], count[z : z + 100_000], needed(threshold, n[x], n[y]))


def _shared(limit: int, threshold: float):
    """Buckets come sorted; each is counted when its last row is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            for k, *row in zip(*(b.column(x).to_pylist() for x in ("k", "c", "n", "of", "grams"))):
                if k != key and rows:
                    yield from _in_bucket(rows, limit, threshold)
                    rows = []
                key = k
                rows.append(row)
        if rows:
            yield from _in_bucket(rows, limit, threshold)

    return run


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the buckets, of rows sorted by (a, b): the counts of what is missing, which come first for each a, and the pairs for which that of a leaves the threshold in reach."""
    rest = None
    for b in chain(batches, [None]):
        got = None if b is None else [b.column(x).to_numpy() for x in ("a", "b", "of", "need")]
        rows = got if rest is None else rest if got is None else [np.concatenate(x) for x in zip(rest, got)]
        if rows is None or not len(rows[0]):
            continue
        end = len(rows[0]) if b is None else int(np.searchsorted(rows[0], rows[0][-1]))
        rest = [x[end:] for x in rows]
        if not end:
            continue
        x, y, of, need = (x[:end] for x in rows)
        at = _new(x, y)
        x, y, of, need = x[at], y[at], np.add.reduceat(of, at), need[at]
        first = _new(x)
        first = np.repeat(first, np.diff(np.append(first, len(x))))
        ok = (x == y) | (of + np.where(x[first] == y[first], of[first], 0) >= need)
        yield _counted(x[ok], y[ok], of[ok], need[ok])


def _grams(n: int, known):
    """(doc_id, c, grams) with the sets of the classes of a filter; equal rows of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            h, _, at = _sets(b.column("text"), n)
            size = np.diff(at)
            some = np.flatnonzero(size)
            if not len(some):
                continue
            data = h.tobytes()
            doc, c = ids(b)[some], _class(h, at[:-1][some], size[some])
            keep = np.unique(np.stack([doc, c], 1), axis=0, return_index=True)[1]
            keep = keep[_has(known.value, c[keep])]
            for i in range(0, len(keep), 256):
                part = keep[i : i + 256]
                yield pa.record_batch([pa.array(doc[part]), pa.array(c[part]), pa.array([data[8 * at[some[k]] : 8 * at[some[k] + 1]] for k in part], pa.binary())], ["doc_id", "c", "grams"])

    return run


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each task of each class; a set is not copied before its batch is sent on."""
    for b in batches:
        for i in range(0, b.num_rows, 64):
            part = b.slice(i, 64)
            tasks = part.column("tasks")
            rep = pa.array(np.repeat(np.arange(part.num_rows), tasks.value_lengths().to_numpy(zero_copy_only=False)))
            yield pa.record_batch([tasks.flatten(), part.column("c").take(rep), part.column("grams").take(rep)], ["task", "c", "grams"])


def needed(threshold: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap with which sets of these sizes reach the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BITS // 8), np.uint8)
    for i, s in enumerate(sets):
        bit = (s & U(BITS - 1)).astype(np.int64)
        np.bitwise_or.at(out[i], bit >> 3, np.uint8(1) << (bit & 7).astype(np.uint8))
    return out.view(np.uint64)


def _overlap(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 2048) -> np.ndarray:
    """Bits that rows a of x and b of y have in common."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), step):
        out[i : i + step] = np.bitwise_count(x[a[i : i + step]] & y[b[i : i + step]]).sum(1)
    return out


class Tree:
    """Levels of nodes from the sets up; each node covers ``LEAF`` nodes of the level below."""

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        excess = size - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, size, size, excess)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(lo), LEAF)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))


def _root_ranges(root: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The least and greatest root below each node, for all levels."""
    out = [(root, root)]
    while len(out[-1][0]) > 1:
        at = np.arange(0, len(out[-1][0]), LEAF)
        out.append((np.minimum.reduceat(out[-1][0], at), np.maximum.reduceat(out[-1][1], at)))
    return out


def traverse(x: Tree, y: Tree, threshold: float, same: bool, roots: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets that no bound excludes; with ``same``, each unordered pair of one tree once. roots: those of one root are connected."""
    known = None if roots is None else tuple(map(_root_ranges, roots))
    height = max(len(x.levels), len(y.levels)) - 1
    u, v = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(height, -1, -1):
        bx, lox, hix, exx = x.levels[min(level, len(x.levels) - 1)]
        by, loy, hiy, exy = y.levels[min(level, len(y.levels) - 1)]
        if level < height:
            if level < len(x.levels) - 1:
                u, v = np.repeat(u * LEAF, LEAF) + np.tile(np.arange(LEAF), len(u)), np.repeat(v, LEAF)
                ok = u < len(lox)
                u, v = u[ok], v[ok]
            if level < len(y.levels) - 1:
                u, v = np.repeat(u, LEAF), np.repeat(v * LEAF, LEAF) + np.tile(np.arange(LEAF), len(v))
                ok = v < len(loy)
                u, v = u[ok], v[ok]
            if same:
                ok = u < v if level == 0 else u <= v
                u, v = u[ok], v[ok]
        ok = (lox[u] * threshold <= hiy[v] + 1e-9) & (loy[v] * threshold <= hix[u] + 1e-9)
        if known:
            (a, z), (c, d) = (k[min(level, len(k) - 1)] for k in known)
            ok &= (np.minimum(a[u], c[v]) != np.maximum(z[u], d[v]))
        u, v = u[ok], v[ok]
        common = _overlap(bx, by, u, v)
        most = np.minimum(np.minimum(common + exx[u], common + exy[v]), np.minimum(hix[u], hiy[v]))
        ok = most >= needed(threshold, lox[u], loy[v])
        u, v = u[ok], v[ok]
    return u, v


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def join_task(doc: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float, every: bool, links: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Verified pairs of one task. side: 0 a tree with itself, else 1 against 2. Unless ``every``, pairs already connected are skipped.

    links: all pairs are verified and counted there for both of them; only those that connect are returned.
    """
    found: list[tuple[int, int, float]] = []
    root = np.arange(len(doc))

    def check(i: int, j: int) -> None:
        if every or root[i] != root[j]:
            similar = _jaccard(sets[i], sets[j])
            if similar >= threshold:
                if links is not None:
                    links[i] += 1
                    links[j] += 1
                a, b = root[i], root[j]
                if links is None or a != b:
                    found.append((int(doc[i]), int(doc[j]), similar))
                if a != b:
                    root[root == max(a, b)] = min(a, b)

    size = np.array([len(s) for s in sets], np.int64)
    one, two = (np.arange(len(doc)),) * 2 if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    if len(doc) <= 2 * LEAF:
        for p, i in enumerate(one):
            for j in two[p + 1 :] if not side.any() else two:
                if min(size[i], size[j]) >= threshold * max(size[i], size[j]) - 1e-9:
                    check(i, j)
        return found
    # alike sets have the same least hashes: in that order, the members of a node are alike and their bitmaps overlap
    one, two = (x[np.lexsort(([sets[i][min(1, len(sets[i]) - 1)] for i in x], [sets[i][0] for i in x]))] for x in (one, two))
    bits = _bitmaps(sets)
    if not every:
        for x in (one, two) if side.any() else (one,):
            for i, j in zip(x, x[1:]):
                check(i, j)
        if side.any() and len(one) and len(two):
            check(one[0], two[0])
    tree = Tree(bits[one], size[one])
    other = tree if not side.any() else Tree(bits[two], size[two])
    u, v = traverse(tree, other, threshold, not side.any(), None if every else (root[one], root[two]))
    i, j = one[u], two[v]
    for k in range(0, len(i), 1024):
        a, b = i[k : k + 1024], j[k : k + 1024]
        if not every:
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
        for p, q in zip(a, b):
            check(p, q)
    return found


def _join(threshold: float, every: bool, links: bool):
    """Tasks come sorted; each is joined when its last row is there. With ``links``, also (c, c, number of links in the task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, side, grams = None, [], [], []
        out: list[tuple[int, int, float]] = []

        def close() -> None:
            if len(doc) > 1:
                of = np.zeros(len(doc), np.int64) if links else None
                out.extend(join_task(np.array(doc), grams, np.array(side), threshold, every, of))
                if links:
                    out.extend((doc[k], doc[k], float(of[k])) for k in np.flatnonzero(of))

        def flush() -> pa.RecordBatch:
            a, b, s = zip(*out) if out else ((), (), ())
            out.clear()
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "jaccard"])

        for batch in batches:
            rows = batch.to_pydict()
            for k, s, d, g in zip(zip(rows["anchor"], rows["x"], rows["y"]), rows["side"], rows["c"], rows["grams"]):
                if k != key:
                    close()
                    key, doc, side, grams = k, [], [], []
                doc.append(d)
                side.append(s)
                grams.append(np.frombuffer(g, U))
            if len(out) > 10_000:
                yield flush()
        close()
        yield flush()

    return run


def _prefix(threshold: float, n):
    """Of how many n-grams, in an order that all sets share, two sets that reach the threshold have one in common."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _route(anchors: int | None, hot, threshold: float):
    """(c, n, anchor): the trees of each class, given the sorted n-grams of large trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = b.column("least")
            per = least.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = least.flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), per)
            first = np.cumsum(per) - per
            place = np.arange(len(flat)) - first[row]
            known = hot.value
            large = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool)
            others = np.cumsum(~large)
            rank = others - 1 - np.where(first > 0, others[np.maximum(first - 1, 0)], 0)[row]
            if anchors is None:
                cold = np.bincount(row[~large], minlength=b.num_rows)
                at = np.flatnonzero(np.where(large, cold[row] + place - rank - 1, rank) < _prefix(threshold, per)[row])
                yield pa.record_batch([b.column("c").take(pa.array(row[at])), b.column("n").take(pa.array(row[at])), pa.array(flat[at])], ["c", "n", "anchor"])
                continue
            touched = np.bincount(row[large & (place < anchors)], minlength=b.num_rows) > 0
            stay = np.bincount(row[large], minlength=b.num_rows) * 4 > per
            take = np.where(touched[row], (~large & (rank < 2 * anchors)) | (stay[row] & large & (place < anchors)), place < anchors)
            at = pa.array(row[take])
            yield pa.record_batch([b.column("c").take(at), b.column("n").take(at), pa.array(flat[take])], ["c", "n", "anchor"])

    return run


def _route_by_join(classes: DataFrame, hot: DataFrame, anchors: int | None, threshold: float) -> DataFrame:
    """What ``_route`` gives, with the n-grams of large trees as a table."""
    each = classes.select("c", "n", F.posexplode("least").alias("at", "anchor")).join(hot.withColumn("hot", F.lit(True)), "anchor", "left")
    rows = each.groupBy("c", "n").agg(F.count("hot").alias("hot"), F.count("*").alias("all"), F.sort_array(F.collect_list(F.struct("at", "anchor", "hot"))).alias("each"))
    if anchors is None:
        order = F.concat(F.filter("each", lambda x: x["hot"].isNull()), F.filter("each", lambda x: x["hot"].isNotNull()))
        prefix = F.expr(f"cast(`all` - ceil({threshold!r}D * `all` - 1e-9D) + 1 as int)")
        return rows.select("c", "n", F.explode(F.transform(F.slice(order, F.lit(1), prefix), lambda x: x["anchor"])).alias("anchor"))
    first = F.filter("each", lambda x: x["at"] < anchors)
    cold = F.slice(F.filter("each", lambda x: x["hot"].isNull()), 1, 2 * anchors)
    large = F.filter(first, lambda x: x["hot"].isNotNull())
    moved = F.when(F.col("hot") * 4 > F.col("all"), F.concat(cold, large)).otherwise(cold)
    return rows.select("c", "n", F.explode(F.transform(F.when(F.size(large) > 0, moved).otherwise(first), lambda x: x["anchor"])).alias("anchor"))


def _spread(classes: DataFrame, anchors: int | None, most: int, threshold: float = THRESHOLD) -> DataFrame:
    """(c, n, anchor): the trees of each class. Classes leave trees of more than ``most`` until no other tree has grown above it.

    With no number of anchors ``least`` has the whole sets, and each is routed by as many as the threshold needs, those of large trees last: this leaves no
    pair out. A number of anchors leaves some out; the join does not use it.
    """
    shape, hot = "c long, n int, anchor long", None
    while True:
        if hot is None or hot.count() <= SENT:
            known = np.sort(np.array([] if hot is None else [r.anchor for r in hot.collect()], np.int64))
            spread = classes.mapInArrow(_route(anchors, broadcast_value(classes.sparkSession, known), threshold), shape)
        else:
            spread = _route_by_join(classes, hot, anchors, threshold)
        large = spread.groupBy("anchor").count().where(f"count > {most}").select("anchor")
        more = cut(large if hot is None else large.join(broadcast_if(hot), "anchor", "left_anti"))
        if more.isEmpty():
            return spread
        hot = more if hot is None else cut(hot.unionByName(more))


def _candidates(docs: DataFrame, alike: DataFrame, n: int, threshold: float, hot: int) -> DataFrame:
    """(a, b): pairs of classes. Any two classes that reach the threshold are connected by these. alike: what ``_classes`` gives."""
    partitions = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    missing = alike.where("out > 0").groupBy("c").agg(F.first("out").alias("of"), F.first("n").alias("n"))
    missing = missing.select(F.col("c").alias("a"), F.col("c").alias("b"), "of", F.expr(f"cast(ceil({threshold!r}D * n - 1e-9D) as int)").alias("need"))
    edges, known = [], None
    for limit in LEVELS:
        below, buckets = (_below(threshold), int(np.ceil((1 - OUT * threshold) * partitions))) if known is None else (None, partitions)
        parts = docs.mapInArrow(_fragments(n, buckets, known, below), "k int, c binary, n binary, of binary, grams binary").repartition(buckets, "k").sortWithinPartitions("k")
        counted = parts.mapInArrow(_shared(limit, threshold), COUNTED)
        counted = counted.unionAll(missing) if known is None else counted
        sums = cut(counted.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_enough, COUNTED))
        other = sums.where("a = b").select("b", F.col("of").alias("hot"))
        edges.append(sums.where("a <> b").join(other, "b", "left").where("of + coalesce(hot, 0) >= need").select("a", "b"))
        left = sums.where("a = b and of >= need").select(F.col("a").alias("c"))
        if left.isEmpty():
            break
        known = _filter(left)
    else:
        whole = docs.mapInArrow(_summary(n, None, known), "doc_id long, c long, n int, least array<long>")
        classes = cut(whole.groupBy("c").agg(F.first("n").alias("n"), F.first("least").alias("least")))
        before = F.lag(F.struct("c", "n")).over(W.partitionBy("anchor").orderBy("n", "c"))
        chains = _spread(classes, None, hot, threshold).withColumn("p", before).where(f"p.n >= {threshold!r}D * n - 1e-9D")
        edges.append(chains.select(F.col("p.c").alias("a"), F.col("c").alias("b")).distinct())
    out = edges[0]
    for e in edges[1:]:
        out = out.unionAll(e)
    return out


def _edges(docs: DataFrame, n: int, threshold: float, block: int, hot: int, every: bool, links: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, c) with the class of every document, and the verified pairs of classes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).where("doc_id is not null")
    alike = cut(docs.mapInArrow(_classes(n, _below(threshold)), "doc_id long, c long, n int, out int"))
    connected = cut(components(_candidates(docs, alike, n, threshold, hot)))
    members = connected.select(F.col("node").alias("c"), F.col("component").alias("anchor")).unionAll(connected.select(F.col("component").alias("c"), F.col("component").alias("anchor")).distinct())
    members = members.join(members.groupBy("anchor").agg(F.count("*").alias("of")), "anchor")
    by_size = W.partitionBy("anchor").orderBy("n", "c")
    classes = alike.join(members, "c").groupBy("c", "anchor", "of").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    placed = cut(classes.withColumn("block", F.floor((F.row_number().over(by_size) - 1) / block).cast("int")))
    single = placed.where(F.col("of") <= block).select("doc_id", "c", F.struct("anchor", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side")).alias("task"))
    large = placed.where(F.col("of") > block)
    range_ = large.groupBy("anchor", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    p, q = range_.alias("p"), range_.alias("q")
    tasks = p.join(q, F.expr(f"p.anchor = q.anchor and p.block <= q.block and p.hi >= {threshold!r} * q.lo")).select(F.col("p.anchor").alias("anchor"), F.col("p.block").alias("x"), F.col("q.block").alias("y"))
    sides = tasks.select("anchor", "x", "y", F.explode(F.expr("case when x = y then array(struct(x as block, 0 as side)) else array(struct(x as block, 1 as side), struct(y as block, 2 as side)) end")).alias("s"))
    several = large.join(sides.select("anchor", "x", "y", "s.block", "s.side"), ["anchor", "block"]).select("doc_id", "c", F.struct("anchor", "x", "y", "side").alias("task"))
    wanted = single.unionAll(several).groupBy("doc_id", "c").agg(F.collect_list("task").alias("tasks"))
    sets = docs.mapInArrow(_grams(n, _filter(placed)), "doc_id long, c long, grams binary").join(wanted, ["doc_id", "c"])
    if not alike.groupBy("doc_id", "c").count().where("count > 1").isEmpty():
        sets = sets.groupBy("doc_id", "c").agg(F.first("tasks").alias("tasks"), F.first("grams").alias("grams"))
    shape = "task struct<anchor:long,x:int,y:int,side:int>, c long, grams binary"
    rows = sets.select("c", "tasks", "grams").mapInArrow(_tasks, shape).select("task.*", "c", "grams")
    found = rows.repartition("anchor", "x", "y").sortWithinPartitions("anchor", "x", "y").mapInArrow(_join(threshold, every or links, links), "a long, b long, jaccard double")
    return alike.select("doc_id", "c").distinct(), found


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK, hot: int = HOT, links: bool = True) -> DataFrame:
    """(doc_id, group_id, group_size, class_id, links) of every document with a partner; a document without a row has none.

    group_id is the least id of the group, class_id the least id with the same set (of several texts of one id: of any of them), links the number of other
    classes with which the document reaches the threshold. Documents of one class share its links; copies are told by class_id. Without
    ``links`` the last two are not there, and pairs already connected are not compared.
    """
    alike, found = _edges(docs, n, threshold, block, hot, False, links)
    if links:
        found = cut(found)
    member = alike.join(components(found), F.col("c") == F.col("node"), "left").select("doc_id", "c", F.coalesce("component", "c").alias("group"))
    least = member.groupBy("group").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("of")).where("of > 1").select("group", "group_id")
    grouped = cut(member.join(least, "group").groupBy("doc_id").agg(F.min("group_id").alias("group_id"), F.max("group_id").alias("last")))
    several = grouped.where("group_id <> last").select("doc_id", F.col("group_id").alias("a"))
    if not several.isEmpty():  # an id with texts of several groups makes them one
        one = components(member.join(least, "group").join(several, "doc_id").select("a", F.col("group_id").alias("b")))
        grouped = cut(grouped.join(one, F.col("group_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "group_id").alias("group_id")))
    size = grouped.groupBy("group_id").agg(F.count("*").alias("group_size")).where("group_size > 1")
    out = grouped.join(size, "group_id").select("doc_id", "group_id", "group_size")
    if not links:
        return out
    of = found.where("a = b").groupBy(F.col("a").alias("c")).agg(F.sum("jaccard").cast("long").alias("links"))
    least = alike.groupBy("c").agg(F.min("doc_id").alias("class_id"))
    own = alike.join(least, "c").join(of, "c", "left").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    return out.join(own, "doc_id").select("doc_id", "group_id", "group_size", "class_id", "links")


def pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_a, doc_b, jaccard) of every pair, doc_a < doc_b. Quadratic in the size of a group of copies, as its result is."""
    alike, found = _edges(docs, n, threshold, block, hot, True)
    between = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard").where("a <> b").dropDuplicates(["a", "b"])
    x, y = alike.select(F.col("doc_id").alias("p"), F.col("c").alias("a")), alike.select(F.col("doc_id").alias("q"), F.col("c").alias("b"))
    same = x.join(y, F.col("a") == F.col("b")).where("p < q").select("p", "q", F.lit(1.0).alias("jaccard"))
    cross = between.join(x, "a").join(y, "b").select("p", "q", "jaccard")
    both = same.unionAll(cross)
    return both.select(F.least("p", "q").alias("doc_a"), F.greatest("p", "q").alias("doc_b"), "jaccard").where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group, that of the least id; rows without an id or a partner stay."""
    key = fresh(docs.columns, "_surplus")
    surplus = cut(groups(docs, links=False, **options).where("doc_id <> group_id").select(F.col("doc_id").alias(key)))
    return docs.join(surplus, F.col("doc_id").cast("long") == F.col(key), "left_anti")
