"""Suffix-array dedup by prefix-free parsing.

Wanted are the passages of at least ``WORDS`` words that occur in two or more documents: every word inside some window of that
length whose words occur in another document. The first occurrence of each window, by (doc_id, position), is told from its copies.

1. Rolling hashes of ``GRAM`` words trigger phrase ends: a position is a trigger where its hash is the least of some run of a quarter
   window of positions. Phrases overlap by the trigger's words, so they are prefix-free. The middle of every window of ``WORDS`` words
   holds a whole phrase whose triggers the window's own words decide, so equal windows have the same phrases in their middles, and
   windows whose middles have only phrases of a single document are not repeated.
2. Around each other phrase lies the stretch of windows that have it in their middle. Those whose least phrase it is are sent to the bucket of that
   phrase, so equal windows meet, and text without repeats goes no further.
   A phrase with more than ``HOT`` occurrences (a licence line) has no bucket: each of its windows goes to its own hash, where the rows come
   in order and are passed on one by one; none is held but those of the first document.
3. In a bucket, the stretches are parsed again. The suffix array of the dictionary of distinct phrases and that of the parse, both by
   prefix doubling, combine into corpus order: a suffix is ordered by the rank of the rest of its phrase, then by the rank of the
   parse that follows. Neighbours in that order that agree for ``WORDS`` words are one class; classes of several documents are repeats.

Defined cases: null and empty texts have no words; texts of fewer than ``WORDS`` words have no window; rows with a null id are left
out, as they have no identity; repeated rows of one id are one document; an empty table gives an empty result; other columns are not
looked at; words are compared without ASCII case and punctuation. Words count as equal by 32 bits of hash, that is windows by 1600.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .tokens import STEP, U, ids, mix, pieces, rows_of, text_buffer, tokens

WORDS = 50
GRAM = 4
CHUNK = 200_000
HOT = 20_000
BYTES = 4
_INVERSE = pow(STEP, -1, 1 << 64)
_cache: dict[str, np.ndarray] = {}


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("p", ())) < n:
        size = max(n, 1 << 16)
        for k, base in (("p", STEP), ("q", _INVERSE)):
            x = np.full(size, base, U)
            x[0] = 1
            _cache[k] = np.multiply.accumulate(x)
    return _cache["p"], _cache["q"]


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over x[i : i + n] for every full window, by doubling."""
    width, out = 1, x
    while width * 2 <= n:
        out = op(out[: len(out) - width], out[width:])
        width *= 2
    rest = n - width
    return op(out[: len(out) - rest], out[rest:]) if rest else out


class Ranges:
    """Hashes of any range of a token sequence from one running sum."""

    def __init__(self, t: np.ndarray):
        p, self.q = _steps(len(t) + 1)
        self.c = np.zeros(len(t) + 1, U)
        np.cumsum(t * p[: len(t)], out=self.c[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.c[end] - self.c[start]) * self.q[start] + (end - start).astype(U))


def span_of(words: int) -> int:
    """Positions of a run: of the window's positions, those a run away from either end are two runs, enough for two triggers."""
    return (words - GRAM + 3) // 4


def phrases(t: np.ndarray, index: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Ranges]:
    """(row, start, end) of every phrase between two triggers of one row, the closing trigger's words included."""
    span = span_of(words)
    ranges = Ranges(t)
    none = np.zeros(0, np.int64)
    n = len(t) - GRAM + 1
    if n < span:
        return none, none, none, ranges
    row = rows_of(index)
    at = np.arange(n)
    h = ranges(at, at + GRAM)
    least = _slide(h, span, np.minimum)
    inside = row[: len(least)] == row[span - 1 + GRAM - 1 : span - 1 + GRAM - 1 + len(least)]
    least = np.where(inside, least, U(0))
    padded = np.concatenate([np.zeros(span - 1, U), least, np.zeros(span - 1, U)])
    trigger = np.flatnonzero((_slide(padded, span, np.maximum)[:n] == h) & (h > 0))
    a, b = trigger[:-1], trigger[1:]
    same = row[a] == row[b]
    return row[a[same]], a[same], b[same] + GRAM, ranges


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, of ``BYTES`` bytes, and each row's range in them."""
    raw, off = text_buffer(column)
    t, _, _, index = tokens(raw, off)
    return t >> U(64 - 8 * BYTES), index


def _phrases(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            t, index = _words(b.column("text"))
            row, s, e, ranges = phrases(t, index, words)
            if len(s):
                yield pa.record_batch([pa.array(ranges(s, e).view(np.int64)), pa.array(ids(b)[row])], ["phrase", "doc_id"])

    return run


def _pack(t: np.ndarray) -> np.ndarray:
    return t.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]


def _unpack(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(x, np.uint8).reshape(-1, BYTES)
    return out.reshape(-1).view("<u8").astype(U)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, body): the words in place of the text, which is longer."""
    for b in pieces(batches, "text"):
        t, index = _words(b.column("text"))
        data = _pack(t).tobytes()
        yield pa.record_batch([pa.array(ids(b)), pa.array([data[BYTES * i : BYTES * j] for i, j in zip(index, index[1:])], pa.binary())], ["doc_id", "body"])


def _stretches(words: int):
    """For each phrase that several documents have: the windows of which it is the least phrase, with their words.

    Of the phrases marked as hot, each window on its own, under its own hash and without words.
    """

    span = span_of(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "body"):
            bodies = b.column("body").to_pylist()
            t, index = _unpack(b"".join(bodies)), np.concatenate([[0], np.cumsum([len(x) // BYTES for x in bodies])])
            row, s, e, ranges = phrases(t, index, words)
            if not len(s):
                continue
            h = ranges(s, e)
            shared = b.column("phrases")
            flat, warm = (shared.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("phrase", "hot"))
            flat = flat.view(U)
            bounds = np.concatenate([[0], np.cumsum(shared.value_lengths().to_numpy())])
            doc = ids(b)
            packed = _pack(t)
            out, single = [], []
            for r in np.unique(row):
                lo, hi = np.searchsorted(row, (r, r + 1))
                hs, ss, es = h[lo:hi], s[lo:hi], e[lo:hi]
                mine, marked = flat[bounds[r] : bounds[r + 1]], warm[bounds[r] : bounds[r + 1]].astype(bool)
                often = np.isin(hs, mine)
                first, count = int(index[r]), int(index[r + 1] - index[r] - words + 1)
                if count <= 0 or not often.any():
                    continue
                # the phrases in the middle of window w, whatever lies around it, are a range [a, z)
                w = first + np.arange(count)
                a, z = np.searchsorted(ss, w + span - 1), np.searchsorted(es, w + words + 1 - span, side="right")
                width = z - a
                choice = np.full(count, -1)
                best = np.full(count, 2**64 - 1, U)
                for k in range(int(width.max(initial=0))):
                    j = np.minimum(a + k, len(hs) - 1)
                    better = (k < width) & ((hs[j] < best) | (choice < 0))
                    best[better], choice[better] = hs[j[better]], j[better]
                ok = (choice >= 0) & often[np.maximum(choice, 0)]
                hot = ok & np.isin(hs, mine[marked])[np.maximum(choice, 0)]
                if hot.any():
                    at = np.flatnonzero(hot)
                    single.append((ranges(first + at, first + at + words).view(np.int64), np.full(len(at), doc[r]), at))
                key = np.where(ok & ~hot, choice, -1)
                cuts = np.flatnonzero(np.diff(key)) + 1
                for p, q in zip([0, *cuts], [*cuts, count]):
                    if key[p] >= 0:
                        out.append((int(hs[key[p]].view(np.int64)), int(doc[r]), int(p), int(q - p), packed[first + p : first + q - 1 + words].tobytes()))
            if single:
                w, d, at = (np.concatenate(c) for c in zip(*single))
                yield pa.record_batch([pa.array(w), pa.array(d), pa.array(at.astype(np.int32)), pa.array(np.ones(len(w), np.int32)), pa.nulls(len(w), pa.binary())], ["phrase", "doc_id", "start", "windows", "body"])
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["phrase", "doc_id", "start", "windows", "body"])

    return run


def rank_suffixes(x: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes x[i : last[i]], equal ones alike, by prefix doubling up to ``depth`` signs."""
    _, rank = np.unique(x, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width = 1
    at = np.arange(len(x))
    while width < depth:
        follow = at + width
        second = np.where(follow < last, rank[np.minimum(follow, len(x) - 1)], 0)
        both = rank * (len(x) + 2) + second
        _, new = np.unique(both, return_inverse=True)
        new = new.astype(np.int64) + 1
        width *= 2
        if new.max(initial=0) == rank.max(initial=0):
            return new
        rank = new
    return rank


def corpus_order(words_of: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix-free parse of the stretches: (position, dictionary rank, parse rank) order keys of every position, concatenated.

    Returns the order of the positions, the text and the first position of each stretch.
    """
    size = np.array([len(x) for x in words_of])
    first = np.concatenate([[0], np.cumsum(size)])
    text = np.concatenate(words_of)
    n = len(text)
    # triggers of the inner parse: a word's hash decides; the last word of a stretch closes its last phrase
    close = (mix(text) & U(7)) == 0
    close[first[1:] - 1] = True
    ends = np.flatnonzero(close)  # a phrase is the words after the last trigger up to and with the next
    starts = np.concatenate([[0], ends[:-1] + 1])
    ranges = Ranges(text)
    tail = np.isin(ends, first[1:] - 1)
    name = ranges(starts, ends + 1) + tail.astype(U)  # a stretch's last phrase ends by itself, not by a trigger
    _, one, phrase = np.unique(name, return_index=True, return_inverse=True)
    length = ends - starts + 1
    # the dictionary: each distinct phrase once, and the suffix array of it
    d_len = length[one]
    d_first = np.concatenate([[0], np.cumsum(d_len)])
    d_at = np.repeat(starts[one] - d_first[:-1], d_len) + np.arange(d_first[-1])
    d_last = np.repeat(d_first[1:], d_len)
    d_rank = rank_suffixes(text[d_at], d_last, int(d_len.max()))
    # the parse in phrase ranks (the rank of a phrase is that of its whole suffix), and the suffix array of it
    parse = d_rank[d_first[:-1]][phrase]
    of = np.searchsorted(first, starts, side="right") - 1
    p_last = np.searchsorted(of, of, side="right")
    p_rank = rank_suffixes(parse, p_last, words)
    follow = np.where(np.arange(len(parse)) + 1 < p_last, p_rank[np.minimum(np.arange(len(parse)) + 1, len(parse) - 1)], 0)
    mine = np.repeat(np.arange(len(starts)), length)
    alpha = d_rank[d_first[:-1][phrase[mine]] + np.arange(n) - starts[mine]]
    return alpha * (len(parse) + 2) + follow[mine], text, first


def _runs(value: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of equal positive values within one part."""
    if not len(value):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turn = np.flatnonzero((np.diff(value) != 0) | (np.diff(part) != 0)) + 1
    a, z = np.concatenate([[0], turn]), np.concatenate([turn, [len(value)]])
    return a[value[a] > 0], z[value[a] > 0]


def _classes(words: int):
    """A stretch that many documents have is held and ordered once; its documents are a list of (part, doc, start)."""

    def solve(bodies: list[bytes], of: list, doc: list, start: list) -> pa.RecordBatch:
        parts = [_unpack(x) for x in bodies]
        key, text, first = corpus_order(parts, words)
        of_, doc_, start_ = np.array(of), np.array(doc), np.array(start)
        by_part = np.lexsort((start_, doc_, of_))
        of_, doc_, start_ = of_[by_part], doc_[by_part], start_[by_part]
        head = np.searchsorted(of_, np.arange(len(parts)))
        least, most, least_at = doc_[head], np.maximum.reduceat(doc_, head), start_[head]
        count = np.diff(first) - words + 1
        part = np.repeat(np.arange(len(parts)), count)
        inner = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
        pos = first[part] + inner
        order = np.argsort(key[pos], kind="stable")
        window = Ranges(text)(pos, pos + words)[order]
        # corpus order puts suffixes that agree for ``words`` words side by side
        new = np.ones(len(order), bool)
        new[1:] = window[1:] != window[:-1]
        cls = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        d, p = least[part][order], (least_at[part] + inner)[order]
        lo, hi = np.minimum.reduceat(d, heads), np.maximum.reduceat(most[part][order], heads)
        at_lo = np.where(d == lo[cls], p, np.iinfo(np.int64).max)
        first_at = np.minimum.reduceat(at_lo, heads)
        several = (lo != hi)[cls]
        flag = np.zeros(len(order), np.int8)
        flag[order] = np.where(several, np.where((d == lo[cls]) & (p == first_at[cls]), 1, 2), 0)
        out: list[tuple] = []
        # the first occurrence of a window is in the first instance of its part, so all other instances are copies
        a, z = _runs(flag, part)
        begin = least_at[part[a]] + inner[a]
        out.append((least[part[a]], begin, begin + (z - a) - 1 + words, flag[a] == 2))
        a, z = _runs((flag > 0).astype(np.int8), part)
        instances = np.diff(np.append(head, len(of_))) - 1
        times = instances[part[a]]
        run = np.repeat(np.arange(len(a)), times)
        which = head[part[a]][run] + 1 + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
        begin = start_[which] + inner[a][run]
        out.append((doc_[which], begin, begin + (z - a)[run] - 1 + words, np.ones(len(run), bool)))
        d, b, e, c = (np.concatenate(x) for x in zip(*out))
        return pa.record_batch([pa.array(d.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(e.astype(np.int64)), pa.array(c)], ["doc_id", "first_word", "end_word", "is_copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held: list[list] = [[], [], []]
        size, last = 0, None
        # of the window at hand: its hash, the least document, that one's places so far, and whether another one has it
        window, least, places, open_ = None, 0, [], True
        for b in batches:
            alone = b.column("body").is_null().to_numpy(zero_copy_only=False)
            if alone.any():
                part = b.filter(pa.array(alone))
                key, doc, at = (part.column(n).to_numpy() for n in ("phrase", "doc_id", "start"))
                at = at.astype(np.int64)
                cuts = np.flatnonzero(np.diff(key)) + 1
                spans: list[tuple] = []
                for p, q in zip([0, *cuts], [*cuts, len(key)]):
                    if key[p] != window:
                        window, least, places, open_ = key[p], doc[p], [], True
                    z = p
                    if open_:
                        z = p + int(np.searchsorted(doc[p:q], least, side="right"))
                        places += at[p:z].tolist()  # places of one document
                        if z < q:
                            open_ = False
                            places = sorted(set(places))
                            spans.append((np.full(len(places), least), np.array(places), np.arange(len(places)) > 0))
                            places = []
                    if z < q:
                        spans.append((doc[z:q], at[z:q], np.ones(q - z, bool)))
                if spans:
                    d, a, c = (np.concatenate(x) for x in zip(*spans))
                    yield pa.record_batch([pa.array(d.astype(np.int64)), pa.array(a), pa.array(a + words), pa.array(c)], ["doc_id", "first_word", "end_word", "is_copy"])
                b = b.filter(pa.array(~alone))
            for phrase, doc, start, body in zip(*(b.column(n).to_pylist() for n in ("phrase", "doc_id", "start", "body"))):
                if size > CHUNK and phrase != last:  # the stretches of a phrase stay together
                    yield solve(list(known), *held)
                    known, held, size = {}, [[], [], []], 0
                last = phrase
                if body not in known:
                    known[body] = len(known)
                    size += len(body) // BYTES
                for c, x in zip(held, (known[body], doc, start)):
                    c.append(x)
                size += 1
        if known:
            yield solve(list(known), *held)

    return run


def repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, first_word, end_word, n_words, is_copy): the repeated passages of each document, in words from 0, the end excluded.

    Overlapping repeated windows are one passage; windows that are first occurrences and those that are copies are joined apart.
    """
    if words < 2 * GRAM:
        raise ValueError(f"words must be at least {2 * GRAM}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    found = rows.mapInArrow(_phrases(words), "phrase long, doc_id long")
    several = cut(found.groupBy("phrase").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("phrase", (F.col("n") > HOT).alias("hot")))
    per_doc = found.join(several, "phrase").groupBy("doc_id").agg(F.collect_set(F.struct("phrase", "hot")).alias("phrases"))
    stretches = rows.mapInArrow(_packed, "doc_id long, body binary").join(per_doc, "doc_id").mapInArrow(_stretches(words), "phrase long, doc_id long, start int, windows int, body binary")
    placed = stretches.repartition("phrase").sortWithinPartitions("phrase", F.col("body").isNull(), "doc_id", "start")
    spans = placed.mapInArrow(_classes(words), "doc_id long, first_word long, end_word long, is_copy boolean")
    inside = W.partitionBy("doc_id", "is_copy").orderBy("first_word", "end_word")
    reach = F.max("end_word").over(inside.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("first_word") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "is_copy", "island").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
    return merged.select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "is_copy")


ORACLE = f"""
with tok as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\\x00-\\x7F])+') as ws from documents
), win as (select doc_id, unnest(range(0, len(ws) - {WORDS} + 1)) as p, ws from tok where len(ws) >= {WORDS}),
h as (select doc_id, p, md5(array_to_string(ws[p + 1 : p + {WORDS}], ' ')) as m from win),
c as (select m, min((doc_id, p)) as head from h group by m having min(doc_id) <> max(doc_id)),
f as (select h.doc_id, h.p, (h.doc_id, h.p) <> c.head as is_copy from h join c using (m)),
g as (select *, p - coalesce(lag(p) over (partition by doc_id, is_copy order by p), p - 2 * {WORDS}) > {WORDS} as new from f),
i as (select *, sum(new::int) over (partition by doc_id, is_copy order by p) as island from g)
select doc_id, min(p)::bigint as first_word, (max(p) + {WORDS})::bigint as end_word, (max(p) + {WORDS} - min(p))::bigint as n_words, is_copy from i group by doc_id, is_copy, island
"""
