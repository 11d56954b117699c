"""Context-triggered piecewise hashing: fingerprints that stay alike when part of a text changes.

A rolling hash over seven bytes ends a chunk wherever it hits the block size 3 * 2**k; each chunk gives one
base-64 letter.  k is the largest with at least ``LEAST`` chunk ends in the text (0 for short texts), so it
depends on the text alone.  A fingerprint is ``blocksize:letters:letters at the doubled block size``; the last
of ``MOST`` letters covers the rest of the text.  Two fingerprints are compared by edit distance where their
block sizes are equal or one is twice the other; else their likeness is 0.

Null text counts as empty; empty texts share one fingerprint; rows of equal doc_id stand in the order of their
texts; a single document follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes import mix, slices, span_hashes, utf8
from .stages import keep

LEAST, MOST, WIDTH, LEVELS = 32, 64, 7, 32
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
ROLL = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def triggers(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the hash of the last seven bytes of their text is divisible by 3, with its powers of 2."""
    n, docs = len(buf), len(off) - 1
    at = np.arange(n) + WIDTH * np.repeat(np.arange(docs), np.diff(off))  # gaps keep texts apart
    value = np.zeros(n + WIDTH * docs, np.uint32)
    value[at] = ROLL[buf]
    h = value.copy()
    for j in range(1, WIDTH):
        h[j:] += value[:-j] * np.uint32(pow(0x01000193, j, 1 << 32))
    h = h[at]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    hit = np.flatnonzero(h % np.uint32(3) == 0)
    low = h[hit] | np.uint32(1 << 31)
    low &= ~low + np.uint32(1)
    return hit, np.log2(low.astype(np.float64)).astype(np.int64)


def letters(buf: np.ndarray, off: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """One letter per chunk of each text; ``ends`` are the last bytes of the chunks."""
    docs = len(off) - 1
    doc = np.searchsorted(off, ends, "right") - 1
    rank = np.arange(len(ends)) - np.searchsorted(doc, np.arange(docs))[doc]
    ends = ends[rank < MOST - 1] + 1
    full = np.flatnonzero(np.diff(off))
    stops = np.union1d(ends, off[full + 1])
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    text = LETTERS[(span_hashes(buf, starts, stops) >> np.uint64(58)).astype(np.int64)].tobytes()
    edge = np.searchsorted(starts, off)
    edge[-1] = len(starts)
    return [text[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def fingerprints(buf: np.ndarray, off: np.ndarray) -> list[str]:
    docs = len(off) - 1
    hit, level = triggers(buf, off)
    doc = np.searchsorted(off, hit, "right") - 1
    count = np.bincount(doc * LEVELS + level, minlength=docs * LEVELS).reshape(docs, LEVELS)
    above = count[:, ::-1].cumsum(1)[:, ::-1]
    k = np.maximum((above >= LEAST).sum(1) - 1, 0)
    fine = letters(buf, off, hit[level >= k[doc]])
    coarse = letters(buf, off, hit[level >= k[doc] + 1])
    return [f"{3 << i}:{a.decode()}:{b.decode()}" for i, a, b in zip(k.tolist(), fine, coarse, strict=True)]


def of_texts(texts: list[str]) -> list[str]:
    return fingerprints(*utf8(pa.array(texts, pa.large_string())))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the larger share of letters left by the edit distance at a common block size."""
    def near(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, 0.0).otherwise(1.0 - F.levenshtein(x, y) / longest)

    p, q = F.split(a, ":"), F.split(b, ":")
    i, j = p[0].cast("bigint"), q[0].cast("bigint")
    return (F.when(a == b, 1.0).when(i == j, F.greatest(near(p[1], q[1]), near(p[2], q[2])))
            .when(i == 2 * j, near(p[1], q[2])).when(j == 2 * i, near(p[2], q[1])).otherwise(0.0))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


ROW = ("part int, doc_id bigint, n_chars bigint, fingerprint string, edited_sha256 string, edited_fingerprint string, "
       "next_fingerprint string, head string, tail string")


def neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text and of the document after it (ascending doc_id, cyclic)."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, first = TaskContext.get().partitionId(), [], True

        def rows(known: list, closed: bool) -> pa.RecordBatch:
            nonlocal first
            ids, texts, prints = zip(*known, strict=True)
            n = len(ids) if closed else len(ids) - 1
            new = [edited(texts[i], texts[i + 1]) for i in range(len(ids) - 1)]
            marks = of_texts(new)
            blank = [None] * closed
            head = [texts[0] if first and n else None] + [None] * (n - 1)
            tail = [None] * (n - 1) + [texts[-1] if closed else None]
            first = first and not n
            cols = ([part] * n, ids[:n], list(map(len, texts[:n])), prints[:n],
                    [hashlib.sha256(x.encode()).hexdigest() for x in new] + blank, marks + blank, [*prints[1:], *blank][:n], head[:n], tail[:n])
            kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 6)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])

        for batch in batches:
            for piece in slices(batch):
                texts = [x or "" for x in piece["text"].to_pylist()]
                known = held + list(zip(piece["doc_id"].to_pylist(), texts, of_texts(texts), strict=True))
                if len(known) > 1:
                    yield rows(known, False)
                held = known[-1:]
        if held:
            yield rows(held, True)

    found, _ = keep(ordered.mapInArrow(run, ROW))
    # the last document of each partition meets the first of the next: two texts per partition
    parts = [r["part"] for r in found.where(F.col("tail").isNotNull()).select("part").orderBy("part").collect()]
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    heads = found.where(F.col("head").isNotNull()).select(F.col("part").alias("next"), F.col("head").alias("following"), F.col("fingerprint").alias("print"))
    ends = found.where(F.col("tail").isNotNull()).join(after, "part").join(heads, "next").select(
        "doc_id", "n_chars", "fingerprint", "tail", "following", F.col("print").alias("next_fingerprint"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch[k][i].as_py() for k in batch.schema.names}
                new = edited(r["tail"], r["following"])
                yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "n_chars": r["n_chars"], "fingerprint": r["fingerprint"], "edited_sha256": hashlib.sha256(new.encode()).hexdigest(),
                                                   "edited_fingerprint": of_texts([new])[0], "next_fingerprint": r["next_fingerprint"]}])

    narrow = "doc_id bigint, n_chars bigint, fingerprint string, edited_sha256 string, edited_fingerprint string, next_fingerprint string"
    inner = found.where(F.col("tail").isNull()).select(*[x.split()[0] for x in narrow.split(", ")])
    return inner.unionByName(ends.mapInArrow(finish, narrow))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return neighbours(docs).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
