"""Order-preserving packing of documents into training sequences by dynamic programming.

The token stream of a range of documents is cut into windows of at most ``length`` ids.  Cuts may lie at
document ends (free), after a token that ends a sentence (``sentence_cost``) and, where a sentence is longer
than a window, anywhere (``hard_cost``).  Within a run of about ``RUN`` ids the cuts minimise padding plus these
truncation costs; the best predecessor of each cut is the head of a monotone queue over the windows that can reach
it, so the work is linear in the cuts.

Null text counts as empty (only the end id); equal doc_ids and repeated rows are documents of their own, in
the order of their texts; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytes import slices, utf8
from .tokens import Encoder

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint")
#: Ids solved at once.  The last window of a solved run stays open and begins the next run.
RUN = 1 << 20
#: Room for the sequences of one partition in a sequence id.
LOCAL_BITS = 40


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """Indexes into ``at`` (ascending, from 0, steps of at most ``length``) of the cheapest cuts.

    ``cost[j]`` is paid for a cut at ``at[j]``; a window pays one for each place of padding.  With f the least
    cost up to a cut, f(j) = length - at[j] + cost[j] + min over i in reach of (f(i) + at[i]).
    """
    p, c = at.tolist(), cost.tolist()
    back = [0] * len(p)
    queue: deque[tuple[float, int]] = deque([(0, 0)])  # (f(i) + at[i], i), both ascending
    for j in range(1, len(p)):
        reach = p[j] - length
        while p[queue[0][1]] < reach:
            queue.popleft()
        best, i = queue[0]
        back[j] = i
        value = best + length + c[j]  # f(j) + at[j]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(p) - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, closes: np.ndarray, length: int, sentence_cost: float,
               hard_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, with their costs.

    In a stretch longer than a window any place will do.  Padding depends on the number of cuts there only, so whole
    windows from each cut that reaches into the stretch are enough: no other place gives less.
    """
    soft = np.flatnonzero(closes[ids]) + 1
    at = np.union1d(soft, ends)
    at = np.concatenate([[0], at[at > 0]])
    cost = np.full(len(at), sentence_cost)
    cost[np.isin(at, ends)] = 0
    cost[0] = 0
    extra = [np.empty(0, np.int64)]
    for i in np.flatnonzero(np.diff(at) > length).tolist():
        # all windows between the last cut before a stretch and the first behind it may as well be full but for one
        begins = np.concatenate([extra[-1], at[max(0, i + 1 - length):i + 1]])
        begins = np.unique(begins[begins > at[i] - length])
        rows = np.arange(length, at[i + 1] - begins[0], length)
        inside = (rows[:, None] + begins).ravel()
        extra.append(inside[inside < at[i + 1]])
    hard = np.concatenate(extra)
    if len(hard):
        order = np.argsort(np.concatenate([at, hard]), kind="stable")
        cost = np.concatenate([cost, np.full(len(hard), hard_cost)])[order]
        at = np.concatenate([at, hard])[order]
    return at, cost


class _Packer:
    """Packs one partition; holds at most one run and the document it ends with."""

    def __init__(self, closes, length, sentence_cost, hard_cost, base):
        self.closes, self.length, self.costs = closes, length, (sentence_cost, hard_cost)
        self.next = base  # sequence id
        self.ids = [np.empty(0, np.uint32)]
        self.docs: list[tuple] = []  # (doc_id, tokens already packed, tokens of the document)
        self.held = 0

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs += zip(doc_ids, [0] * len(doc_ids), counts.tolist(), strict=True)
        self.held += len(ids)

    def solve(self, last: bool) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        ids = np.concatenate(self.ids)
        if not len(ids):
            return out
        ends = np.cumsum([n - done for _, done, n in self.docs])
        at, cost = candidates(ids, ends, self.closes, self.length, *self.costs)
        cuts = at[best_cuts(at, cost, self.length)]
        if not last:
            cuts = cuts[:-1]
        upto = int(cuts[-1]) if len(cuts) else 0
        raw = ids.astype("<u4").tobytes()
        edges = np.union1d(cuts, ends[ends <= upto])
        lo = 0
        doc = np.searchsorted(ends, np.concatenate([[0], edges[:-1]]), "right").tolist()
        seq = np.searchsorted(cuts, np.concatenate([[0], edges[:-1]]), "right").tolist()
        begins = [0, *cuts.tolist()]
        for hi, d, s in zip(edges.tolist(), doc, seq, strict=True):
            doc_id, done, n = self.docs[d]
            first = (int(ends[d - 1]) if d else 0) - done
            for k, v in zip(out, (doc_id, lo - first, hi - lo, zlib.crc32(raw[4 * lo:4 * hi]), n, self.next + s, lo - begins[s]), strict=True):
                out[k].append(v)
            lo = hi
        self.next += len(cuts)
        keep = int(np.searchsorted(ends, upto, "right"))
        docs = self.docs[keep:]
        if docs:
            first = (int(ends[keep - 1]) if keep else 0) - docs[0][1]
            docs[0] = (docs[0][0], upto - first, docs[0][2])
        self.docs, self.ids, self.held = docs, [ids[upto:]], len(ids) - upto
        return out


def sentence_ends(tokenizer: str) -> np.ndarray:
    """Which ids end a sentence: tokens whose text ends with a full stop, question or exclamation mark."""
    vocab = json.loads(tokenizer)["model"]["vocab"]
    out = np.zeros(max(vocab.values()) + 16, bool)
    for token, i in vocab.items():
        out[i] = token.removesuffix("</w>").endswith((".", "!", "?"))
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, sentence_cost: float = 8.0,
         hard_cost: float = 64.0) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``length`` ids of ``tokenizer`` (its JSON text).

    Documents are range-partitioned by doc_id, so order is kept and only each partition's last sequence is
    short.  Returns one row per piece: doc_id, start (ids of the document before it), length, ids_crc32,
    doc_tokens, sequence_id, offset (in its sequence).
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, closes = Encoder.shared(tokenizer), sentence_ends(tokenizer)
        closes[end_id] = False
        packer = _Packer(closes, length, sentence_cost, hard_cost, TaskContext.get().partitionId() << LOCAL_BITS)
        for batch in batches:
            for part in slices(batch):
                ids, counts = encoder(*utf8(part["text"]))
                tails = np.cumsum(counts)
                packer.add(part["doc_id"].to_pylist(), np.insert(ids, tails, end_id).astype(np.uint32), counts + 1)
                if packer.held >= RUN:
                    yield pa.record_batch({k: pa.array(v, pa.int64()) for k, v in packer.solve(False).items()})
        yield pa.record_batch({k: pa.array(v, pa.int64()) for k, v in packer.solve(True).items()})

    return ordered.mapInArrow(run, SCHEMA)
