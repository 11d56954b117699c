"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``window`` consecutive words of one document.  Its minimiser is the least hash among the runs of
``mini`` words in it; consecutive windows with one minimiser form a super-k-mer and travel as one packed string
to the bucket of that minimiser, so equal windows always meet.  In a bucket, windows are sorted by a hash and
equal hashes are compared byte by byte: windows are counted exactly.  A word is removed if a window that covers
it also starts earlier: in a smaller doc_id, or earlier in the same document.

Hot groups: a task sends a super-k-mer on only if it has not sent an earlier equal one, so a third of all rows
being copies costs each bucket one string per task.  Buckets grow in number with the text, not in size.

Null text has no words; a null doc_id counts as the smallest; rows of equal doc_id are not earlier than one
another (equal rows are treated alike); texts shorter than a window lose nothing; an empty table gives no rows;
other columns are kept.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytes import BASE, GAP, join_hashes, mix, powers, ranges, slices, span_hashes, utf8, within, words

#: Packed text per bucket: what one task unpacks at once.
BUCKET_BYTES = 8 << 20
#: Recent super-k-mers a task remembers (a power of two).
PLACES = 1 << 19
OTHER_BASE = 0xD1342543DE82EF95
LEAST_ID = -(1 << 63)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def normal(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with one blank after each, and where each begins."""
    size = e - s
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    out[ranges(at, size)] = buf[~GAP[buf]]
    return out, at


def super_kmers(word_hash: np.ndarray, word_off: np.ndarray, window: int, mini: int):
    """First window, number of windows, minimiser of each run of windows with one minimiser."""
    ok = within(word_off, window)
    if not ok.any():
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    low = least(join_hashes(word_hash, mini), window - mini + 1)[: len(ok)]
    fresh = ok.copy()
    fresh[1:] &= ~ok[:-1] | (low[1:] != low[:-1])
    first_word = word_off[:-1]
    heads = first_word[first_word < len(ok)]
    fresh[heads] = ok[heads]
    begin = np.flatnonzero(fresh)
    stop = np.concatenate([ok, [False]])
    # a run ends before the next one begins or where windows stop
    ends_at = np.flatnonzero(~stop)
    nxt = np.concatenate([begin[1:], [len(ok)]])
    end = np.minimum(nxt, ends_at[np.searchsorted(ends_at, begin)])
    return begin, end - begin, low[begin]


def run_hashes(word_hash: np.ndarray, begin: np.ndarray, n: np.ndarray, base: int) -> np.ndarray:
    sums = np.zeros(len(word_hash) + 1, np.uint64)
    np.cumsum(word_hash * powers(base, len(word_hash)), out=sums[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(word_hash) + 1)
    return mix((sums[begin + n] - sums[begin]) * inverse[begin] + n.astype(np.uint64))


class _Sender:
    """Packs the super-k-mers of a task for their buckets."""

    def __init__(self, buckets: int, window: int, mini: int):
        self.buckets, self.window, self.mini = buckets, window, mini
        self.key = np.zeros((2, PLACES), np.uint64)
        self.seen = np.zeros((3, PLACES), np.int64)  # doc_id, tag, start

    def repeated(self, a, b, doc_id, tag, start) -> np.ndarray:
        """Which super-k-mers equal an earlier one that this task has sent; remembers the others."""
        place = (mix(a) & np.uint64(PLACES - 1)).astype(np.int64)
        # within the slice: in order of content, then of place in the corpus
        order = np.lexsort((start, tag, doc_id, b, a))
        same = np.zeros(len(a), bool)
        same[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        lead = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        top, own = order[lead], order
        earlier = same & ((doc_id[own] > doc_id[top]) | ((tag[own] == tag[top]) & (start[own] > start[top])))
        out = np.zeros(len(a), bool)
        out[order] = earlier
        hit = (self.key[0, place] == a) & (self.key[1, place] == b)
        d, t, s = self.seen[:, place]
        out |= hit & ((d < doc_id) | ((d == doc_id) & (t == tag) & (s < start)))
        new = np.flatnonzero(~out)
        self.key[0, place[new]], self.key[1, place[new]] = a[new], b[new]
        for i, v in enumerate((doc_id, tag, start)):
            self.seen[i, place[new]] = v[new]
        return out

    def __call__(self, part: pa.RecordBatch) -> pa.RecordBatch | None:
        buf, off = utf8(part["text"])
        s, e, word_off = words(buf, off)
        h = span_hashes(buf, s, e)
        begin, n, low = super_kmers(h, word_off, self.window, self.mini)
        if not len(begin):
            return None
        size = n + self.window - 1
        doc = np.searchsorted(word_off, begin, "right") - 1
        doc_id = part["doc_id"].fill_null(LEAST_ID).to_numpy()[doc]
        tag = part["__tag"].to_numpy()[doc]
        start = begin - word_off[doc]
        known = self.repeated(run_hashes(h, begin, size, BASE), run_hashes(h, begin, size, OTHER_BASE), doc_id, tag, start)
        flat, at = normal(buf, s, e)
        at = np.append(at, len(flat))
        bucket = (mix(low) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        names, blobs = [], []
        codec = pa.Codec("zstd", 3)
        for i, j in zip(edges, np.append(edges[1:], len(order)), strict=True):
            own = order[i:j]
            sent, told = own[~known[own]], own[known[own]]
            lo, hi = at[begin[sent]], at[begin[sent] + size[sent]]
            load = pickle.dumps((flat[ranges(lo, hi - lo)].tobytes(), size[sent].astype(np.int32), doc_id[sent], tag[sent].astype(np.int32), start[sent].astype(np.int32),
                                 np.stack([doc_id[told], tag[told], start[told], start[told] + size[told]])), protocol=5)
            names.append(int(bucket[own[0]]))
            blobs.append((len(load), codec.compress(load, asbytes=True)))
        return pa.record_batch({"bucket": pa.array(names, pa.int64()), "raw": pa.array([x[0] for x in blobs], pa.int64()), "packed": pa.array([x[1] for x in blobs], pa.binary())})


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Whether the byte runs at ``a`` and ``b`` are equal."""
    out = np.ones(len(a), bool)
    for i in range(0, len(a), step):
        n = size[i:i + step]
        equal = buf[ranges(a[i:i + step], n)] == buf[ranges(b[i:i + step], n)]
        out[i:i + step] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


def repeated_windows(parts: list[tuple], window: int) -> np.ndarray:
    """Rows doc_id, tag, first word, end of the covered words: windows of a bucket that also start earlier."""
    texts, places, hashes, lengths, keys, base = [], [], [], [], [], 0
    for raw, size, doc_id, tag, start, _ in parts:
        buf = np.frombuffer(raw, np.uint8)
        if not len(buf):
            continue
        s, e, _ = words(buf, np.array([0, len(buf)]))
        edge = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ok = within(edge, window)
        w = np.flatnonzero(ok)
        own = np.searchsorted(edge, w, "right") - 1
        hashes.append(join_hashes(span_hashes(buf, s, e), window)[w])
        places.append(s[w] + base)
        lengths.append(e[w + window - 1] - s[w])
        keys.append(np.stack([doc_id[own], tag[own], start[own] + w - edge[own]]))
        texts.append(buf)
        base += len(buf)
    if not texts:
        return np.empty((4, 0), np.int64)
    h, at, size, (doc_id, tag, start) = np.concatenate(hashes), np.concatenate(places), np.concatenate(lengths), np.concatenate(keys, axis=1)
    by = np.argsort(h, kind="stable")
    twin = h[by][1:] == h[by][:-1]
    several = by[np.concatenate([twin, [False]]) | np.concatenate([[False], twin])]
    if not len(several):
        return np.empty((4, 0), np.int64)
    text = np.concatenate(texts)
    group = h[several]
    equal = np.zeros(len(several), bool)
    equal[1:] = (group[1:] == group[:-1]) & (size[several][1:] == size[several][:-1])
    pos = np.flatnonzero(equal)
    equal[pos] = same_bytes(text, at[several[pos]], at[several[pos - 1]], size[several[pos]])
    number = np.cumsum(~equal)  # of the distinct window
    if (~equal[1:] & (group[1:] == group[:-1])).any():  # two windows share a hash: tell them apart by their bytes
        content = np.array([text[at[i]:at[i] + size[i]].tobytes() for i in several], object)
        _, number = np.unique(content, return_inverse=True)
    order = np.lexsort((start[several], tag[several], doc_id[several], number))
    i, number = several[order], number[order]
    new = np.concatenate([[True], number[1:] != number[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    own = new | np.concatenate([[True], (doc_id[i][1:] != doc_id[i][:-1]) | (tag[i][1:] != tag[i][:-1])])
    lead = np.flatnonzero(own)[np.cumsum(own) - 1]
    bad = i[(doc_id[i] > doc_id[i[first]]) | (start[i] > start[i[lead]])]
    order = np.lexsort((start[bad], tag[bad], doc_id[bad]))
    d, t, s = doc_id[bad][order], tag[bad][order], start[bad][order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + window)]) if len(d) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(d))[: len(begin)] - 1
    return np.stack([d[begin], t[begin], s[begin], s[end] + window])


SPANS = "doc_id bigint, __tag bigint, first bigint, stop bigint"


def repeated_spans(docs: DataFrame, window: int = 20, mini: int = 4) -> DataFrame:
    """Word spans of ``docs`` (doc_id, text, __tag) covered by windows that also start earlier."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    spread = (window - mini + 2) / 2  # mean number of windows in a super-k-mer
    buckets = max(1, math.ceil(total * (spread + window - 1) / spread / BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets, window, mini)
        for batch in batches:
            for part in slices(batch):
                sent = sender(part)
                if sent is not None:
                    yield sent

    def count(group: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        parts = [pickle.loads(codec.decompress(p, r, asbytes=True)) for p, r in zip(group["packed"].to_pylist(), group["raw"].to_pylist(), strict=True)]
        found = np.concatenate([repeated_windows(parts, window), *[p[5] for p in parts]], axis=1)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "__tag", "first", "stop"), found, strict=True)})

    return (docs.mapInArrow(send, "bucket bigint, raw bigint, packed binary").groupBy("bucket").applyInArrow(count, SPANS))


def remove_repeats(docs: DataFrame, window: int = 20, mini: int = 4, all_joined: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) without repeated words; also n_words, n_removed, kept_sha256.

    Kept words are joined by one blank in the texts that lost words, with ``all_joined`` in all.
    ``kept_sha256`` is of the joined words in either case.
    """
    tagged = docs.withColumn("__tag", F.hash("text").cast("bigint"))  # 32 bits: tells rows of one doc_id apart
    spans = repeated_spans(tagged.select("doc_id", "text", "__tag"), window, mini)
    listed = spans.groupBy(F.col("doc_id").alias("__id"), F.col("__tag").alias("__of")).agg(
        F.collect_list("first").alias("__first"), F.collect_list("stop").alias("__stop"))  # bounded by the document itself
    on = (F.coalesce("doc_id", F.lit(LEAST_ID)) == F.col("__id")) & (F.col("__tag") == F.col("__of"))
    joined = tagged.join(listed.hint("shuffle_hash"), on, "left").drop("__id", "__of", "__tag")
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    kept = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed", "kept_sha256")]

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = utf8(part["text"])
        s, e, word_off = words(buf, off)
        gone = np.zeros(len(s) + 1, np.int64)
        first, stop = part["__first"], part["__stop"]
        some = first.fill_null([]).value_lengths().to_numpy()
        shift = np.repeat(word_off[:-1], some)
        np.add.at(gone, first.flatten().to_numpy() + shift, 1)
        np.add.at(gone, stop.flatten().to_numpy() + shift, -1)
        stay = np.cumsum(gone[:-1]) == 0
        flat, at = normal(buf, s, e)
        size = (e - s + 1)[stay]
        text = flat[ranges(at[stay], size)].tobytes()
        edge = np.concatenate([[0], np.cumsum(size)])
        count = np.concatenate([[0], np.cumsum(stay)])[word_off]
        ends = edge[count]
        joined = [text[a:max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        n, left = np.diff(word_off), np.diff(count)
        old = part["text"]
        texts = [x if all_joined or a != b else None for x, a, b in zip(joined, n, left, strict=True)]
        texts = pa.array([None if x is None else x.decode("utf-8", "replace") for x in texts], old.type)
        cols = {f.name: part[f.name] for f in kept}
        cols["text"] = pa.compute.coalesce(texts, old)
        if all_joined:
            cols["text"] = pa.compute.if_else(old.is_valid(), cols["text"], old)
        cols |= {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - left, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in joined])}
        return pa.record_batch(cols)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in slices(batch):
                yield cut(part)

    return joined.mapInArrow(finish, T.StructType(kept + added))
