"""Exact tallies of strings at scale: whole columns travel packed, not row by row.

A task counts a slice of documents with numpy, splits the counts by a hash of their string into buckets and sends one
packed string per bucket.  A bucket merges what it gets as it streams in, so its memory is that of its distinct
(string, label) pairs; buckets grow in number with the text.  Slices merge equal strings before they are sent, so a
string that stands everywhere costs its bucket one entry per slice and label.  Strings are compared whole; the hash only
deals them to buckets.
"""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bytes import span_hashes, utf8

#: Bytes of text per bucket, and the least number of buckets, for small tables to use all cores.
BUCKET_BYTES, LEAST_BUCKETS = 12 << 20, 12
#: New entries a bucket collects before it merges them.
PENDING = 1 << 19
PACKED = "bucket int, packed binary"


def n_buckets(text_bytes: int) -> int:
    return max(LEAST_BUCKETS, -(-text_bytes // BUCKET_BYTES))


def strings(buf: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings that lie one after the other in ``buf``."""
    off = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    if off[-1] >= 1 << 31:
        return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(off), pa.py_buffer(buf))
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(buf))


def pack(text: pa.Array, label: np.ndarray, labels: list[str], ints: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """The entries (text, label, ints) as one packed string per bucket."""
    buf, off = utf8(text)
    bucket = (span_hashes(buf, off[:-1], off[1:]) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    buf, off = utf8(text.take(pa.array(order)))
    lengths, label, ints = np.diff(off).astype(np.int32), label[order].astype(np.int32), [x[order] for x in ints]
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    packed = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        used, local = np.unique(label[a:b], return_inverse=True)
        names = json.dumps([labels[i] for i in used.tolist()]).encode()
        head = np.array([b - a, off[b] - off[a], len(names)], np.int64)
        packed.append(b"".join([head.tobytes(), *[x[a:b].astype(np.int64).tobytes() for x in ints], lengths[a:b].tobytes(),
                                local.astype(np.int32).tobytes(), names, buf[off[a]:off[b]].tobytes()]))
    return pa.record_batch({"bucket": pa.array(bucket[edges[:-1]], pa.int32()), "packed": pa.array(packed, pa.binary())})


class Merger:
    """Merges packed entries; ``ops`` names the integer columns and how each is merged ("sum", "max", ...), or None to keep all."""

    def __init__(self, names: list[str], ops: dict[str, str] | None):
        self.names, self.ops = names, ops
        self.known: dict[str, int] = {}
        self.parts, self.rows, self.settled = [], 0, 0

    def add(self, packed: bytes) -> None:
        n, size, head = np.frombuffer(packed, np.int64, 3).tolist()
        at = 24 + 8 * n * len(self.names)
        lengths, local = np.frombuffer(packed, np.int32, 2 * n, at).reshape(2, n)
        at += 8 * n
        codes = np.array([self.known.setdefault(x, len(self.known)) for x in json.loads(packed[at:at + head])], np.int32)
        cols = {"text": strings(np.frombuffer(packed, np.uint8, size, at + head), lengths), "label": codes[local]}
        for i, name in enumerate(self.names):
            cols[name] = np.frombuffer(packed, np.int64, n, 24 + 8 * n * i)
        self.parts.append(pa.table(cols))
        self.rows += n
        if self.ops is not None and self.rows - self.settled > max(PENDING, self.settled):
            self.table()

    def table(self) -> pa.Table | None:
        """All entries so far, one per (text, label) if they are merged."""
        if not self.parts:
            return None
        out = pa.concat_tables(self.parts)
        if self.ops is not None and self.rows > self.settled:
            out = out.group_by(["text", "label"], use_threads=False).aggregate(list(self.ops.items()))
            out = out.rename_columns(["text", "label", *self.ops])
        self.parts, self.rows, self.settled = [out], out.num_rows, out.num_rows
        return out

    @property
    def labels(self) -> list[str]:
        return list(self.known)


def merged(batches: Iterator[pa.RecordBatch], names: list[str], ops: dict[str, str] | None) -> Merger:
    held = Merger(names, ops)
    for batch in batches:
        for packed in batch.column("packed"):
            held.add(packed.as_buffer().to_pybytes())
    return held


def whole(col) -> pa.Array:
    """A column as one array."""
    return pc.cast(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col, pa.string())
