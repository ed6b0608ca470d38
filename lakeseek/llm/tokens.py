"""Vectorised tokens and n-gram hashes over Arrow string columns.

A text column is one byte buffer. Token borders come from a 256-entry table, and every token's polynomial hash from one
running sum modulo 2**64: ``sum(value[byte] * BASE**position)``. Blocks of bytes keep the work in cache, so the memory
needed follows the number of tokens, never the square of anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = 0xD6E8FEB86659FD93
MIX = 0xBF58476D1CE4E5B9

_ascii = np.arange(256)
_alnum = ((_ascii >= 48) & (_ascii < 58)) | ((_ascii >= 65) & (_ascii < 91)) | ((_ascii >= 97) & (_ascii < 123))
#: Letters, digits and every byte of a character outside ASCII.
WORD = _alnum | (_ascii >= 128)
#: Everything but ASCII white space.
SOLID = ~np.isin(_ascii, [9, 10, 11, 12, 13, 32])
#: Hash values of bytes with ASCII capitals folded, and as they are.
FOLDED = np.where((_ascii >= 65) & (_ascii < 91), _ascii + 32, _ascii).astype(U) + U(1)
EXACT = _ascii.astype(U) + U(1)

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 18)
        for key, base in (("p", BASE), ("q", INVERSE)):
            x = np.full(size, base, dtype=U)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(MIX)
    return x ^ (x >> U(29))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def tokens(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD, value: np.ndarray = FOLDED, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each token, and each row's range in them (``len(offsets)`` indices)."""
    n = len(raw)
    hashes, starts, ends = [], [], []
    at = 0
    while at < n:
        end = min(n, at + block)
        if end < n:
            cut = int(np.searchsorted(offsets, end, side="right")) - 1
            gaps = np.flatnonzero(~inside[raw[max(at, end - 4096) : end]])
            if len(gaps):
                end = max(at, end - 4096) + int(gaps[-1]) + 1
            elif offsets[cut] > at:
                end = int(offsets[cut])
            else:  # a token longer than what was looked at: go on to where it ends
                limit = int(offsets[cut + 1])
                step = 1 << 20
                while end < limit:
                    gaps = np.flatnonzero(~inside[raw[end : min(limit, end + step)]])
                    if len(gaps):
                        end += int(gaps[0])
                        break
                    end = min(limit, end + step)
        part = raw[at:end]
        size = end - at
        m = inside[part]
        lo, hi = np.searchsorted(offsets, (at, end + 1))
        brk = np.zeros(size + 1, bool)
        brk[offsets[lo:hi] - at] = True
        prev = np.empty(size, bool)
        prev[0] = False
        prev[1:] = m[:-1]
        s = np.flatnonzero(m & (~prev | brk[:-1]))
        nxt = np.empty(size, bool)
        nxt[-1] = False
        nxt[:-1] = m[1:]
        e = np.flatnonzero(m & (~nxt | brk[1:])) + 1
        p, q = _power(size)
        c = np.zeros(size + 1, U)
        np.cumsum(value[part] * p[:size], out=c[1:])
        hashes.append(mix((c[e] - c[s]) * q[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    first = np.concatenate(starts)
    return np.concatenate(hashes), first, np.concatenate(ends), np.searchsorted(first, offsets)


def rows_of(index: np.ndarray) -> np.ndarray:
    """The row of each token."""
    return np.repeat(np.arange(len(index) - 1), np.diff(index))


def ngrams(t: np.ndarray, index: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n consecutive tokens, their first token and row. With ``short``, a row of 1 to n-1 tokens gives one hash of all."""
    counts = np.diff(index)
    step = [U(pow(STEP, k, 1 << 64)) for k in range(n)]
    out_h, out_s, out_r = [], [], []
    total = len(t) - n + 1
    if total > 0:
        h = np.zeros(total, U)
        for k in range(n):
            h += t[k : k + total] * step[k]
        ok = np.zeros(len(t) + 1, np.int32)
        full = counts >= n
        np.add.at(ok, index[:-1][full], 1)
        np.add.at(ok, (index[1:] - n + 1)[full], -1)
        keep = np.cumsum(ok[:total]) > 0
        s = np.flatnonzero(keep)
        out_h.append(mix(h[keep]))
        out_s.append(s)
        out_r.append(np.searchsorted(index, s, side="right") - 1)
    if short:
        for r in range(1, n):
            rows = np.flatnonzero(counts == r)
            if len(rows):
                at = index[:-1][rows]
                h = np.zeros(len(rows), U)
                for k in range(r):
                    h += t[at + k] * step[k]
                out_h.append(mix(h))
                out_s.append(at)
                out_r.append(rows)
    if not out_h:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none
    return np.concatenate(out_h), np.concatenate(out_s), np.concatenate(out_r)


def distinct_by_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row, then hash."""
    if len(row) > 1 and (row[1:] < row[:-1]).any():
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    h = h.copy()
    cuts = np.flatnonzero(np.diff(row)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(h)]):
        h[a:b].sort()
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    return h, row


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts are about ``limit`` bytes together; a longer text stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def ids(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
