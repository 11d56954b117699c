"""Words and hashes of whole Arrow batches, computed on their UTF-8 bytes.

Every function takes ``(buf, off)``: the bytes of all texts of a slice and the offsets of each text.
A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the hashes of a few items.
BASE = 0x9E3779B97F4A7C15
#: Bytes of text handled at once; working arrays take about ten times as much.
SLICE = 2 << 20

GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``size`` bytes of text, or one longer row."""
    if not batch.num_rows:
        return
    col = batch.column(column)
    ends = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(off) else np.empty(0, np.uint8)
    return buf, off - off[0]


def spans(word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes, cut between texts."""
    if not len(word):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(len(word) + 1, bool)
    edge[off[off <= len(word)]] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the white-space separated words, and the offsets of each text's words."""
    s, e = spans(~GAP[buf], off)
    return s, e, np.searchsorted(s, off)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole 64-bit word."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, SLICE + 1), base, U64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if n <= 4 * SLICE:
            _powers[base] = have
    return have[:n]


#: A value for each byte at each place of a run's first ``NEAR`` ones; later places mix theirs from these.
NEAR = 64
PLACE_VALUE = mix((np.arange(256 * NEAR, dtype=U64) + U64(1)) * U64(0xD6E8FEB86659FD93))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs: sums of values drawn for each byte and its place in the run.

    Values of different places have nothing in common, unlike the powers of one base, whose sums modulo 2**64
    agree for whole families of texts.
    """
    size = ends - starts
    stop = np.cumsum(size)
    begin = stop - size
    total = int(stop[-1]) if len(stop) else 0
    place = np.arange(total, dtype=np.int32)
    data = buf if total == len(buf) else buf[place + np.repeat((starts - begin).astype(np.int32), size)]
    place -= np.repeat(begin.astype(np.int32), size)
    value = PLACE_VALUE[((place & (NEAR - 1)) << 8) | data]
    if len(size) and int(size.max()) > NEAR:
        far = np.flatnonzero(place >= NEAR)
        value[far] = mix(value[far] + (place[far] >> 6).astype(U64) * U64(BASE))
    if len(size) and int(size.min()) > 0:
        sums = np.add.reduceat(value, begin)
    else:
        before = np.zeros(total + 1, U64)
        np.cumsum(value, out=before[1:])
        sums = before[stop] - before[begin]
    return mix(sums ^ (size.astype(U64) * U64(0xA0761D6478BD642F)))


def join_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive items (also across texts: the caller drops those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out *= U64(BASE)
        out += h[i:i + n]
    return mix(out)


def within(word_off: np.ndarray, k: int) -> np.ndarray:
    """Which of the runs of ``k`` items over the slice lie in one text."""
    n = int(word_off[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for e in word_off[1:-1]:
        ok[max(0, e - k + 1):e] = False
    return ok


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one after the other."""
    total = int(lengths.sum())
    at = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(at - starts, lengths)


def take_spans(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return buf[ranges(starts, lengths)]
