"""Token ids as length-limited canonical Huffman codes, in blocks that decode on their own.

File format: a folder of two Parquet tables.  ``codes`` is the code book: id and code length of each id in use,
the codes follow from the lengths.  ``blocks`` has one row per block.  ``first`` is the number of ids before the block in the whole file,
``n_ids`` its ids, ``doc_ids`` and ``doc_sizes`` its documents, ``bits`` the codes one after the other (most
significant bit first), ``checkpoints`` the bit offset of every ``CHECK``-th id as little-endian 32-bit
deltas.  A block holds whole documents, about ``BLOCK`` ids; one checkpoint is enough to begin decoding, so a
reader may start inside long documents.

Null text counts as empty (only the end id); equal doc_ids are documents of their own, in the order of their
texts; an empty table gives no blocks; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes import slices, utf8
from .stages import drop, keep, stage_path
from .tokens import Encoder

#: Ids of a block and between checkpoints.
BLOCK, CHECK = 1 << 16, 128
#: Longest code; two to this power must be at least the number of ids in use.
MAX_BITS = 18
BLOCK_SCHEMA = "first bigint, n_ids bigint, doc_ids array<bigint>, doc_sizes array<bigint>, bits binary, checkpoints binary"
CODE_SCHEMA = "id int, length int"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids need more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    # level by level: the leaves merged with the pairs of the level below; only how many leaves are in a prefix counts
    levels, current = [], weight
    for _ in range(max_bits - 1):
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weight, pairs])
        is_leaf = np.concatenate([np.ones(len(weight), bool), np.zeros(len(pairs), bool)])
        by = np.argsort(merged, kind="stable")
        current, is_leaf = merged[by], is_leaf[by]
        levels.append(is_leaf)
    take = 2 * len(weight) - 2
    total = np.zeros(len(weight) + 1, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        total[leaves] += 1
        take = 2 * (take - leaves)
    total[take] += 1  # the lowest level holds leaves only
    lengths[order] = np.cumsum(total[::-1])[::-1][1:]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        top = int(lengths.max())
        left = np.concatenate([[0], np.cumsum(np.left_shift(1, top - lengths[order].astype(np.int64)))[:-1]])
        codes[order] = (left >> (top - lengths[order].astype(np.int64))).astype(np.uint64)
    return codes


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ``ids`` as bytes, and the bit offset of each id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    n_words = int(end[-1] + 63 >> 6) + 1 if len(ids) else 0
    out = np.zeros(n_words, np.uint64)
    if len(ids):
        code, word = codes[ids], start >> 6
        room = 64 - (start & 63) - size  # bits left in the word after this code; negative: it runs over
        over = room < 0
        high = np.where(over, code >> np.where(over, -room, 0).astype(np.uint64), code << np.where(over, 0, room).astype(np.uint64))
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[at]] = np.bitwise_or.reduceat(high, at)
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)  # at most one code a word runs over
    return out.astype(">u8").tobytes()[: int(end[-1] + 7 >> 3) if len(ids) else 0], start


class Decoder:
    """Table-driven: the next ``max_bits`` bits name the id and its length."""

    def __init__(self, lengths: np.ndarray):
        self.top = max(1, int(lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        share = np.left_shift(1, self.top - lengths[order].astype(np.int64))
        self.id = np.zeros(1 << self.top, np.uint32)
        self.step = np.ones(1 << self.top, np.int64)
        full = np.repeat(order, share)
        self.id[: len(full)] = full
        self.step[: len(full)] = lengths[full]

    def __call__(self, bits: bytes, checkpoints: np.ndarray, n_ids: int, check: int = CHECK) -> np.ndarray:
        """All ids; the stretches between checkpoints are decoded side by side."""
        data = np.concatenate([np.frombuffer(bits, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint64)
        out = np.zeros((len(checkpoints), check), np.uint32)
        at = checkpoints.astype(np.int64)
        last = 8 * len(bits)
        for k in range(min(check, n_ids)):
            b = np.minimum(at, last) >> 3
            window = data[b] << np.uint64(24) | data[b + 1] << np.uint64(16) | data[b + 2] << np.uint64(8) | data[b + 3]
            key = (window >> (np.uint64(32 - self.top) - (at & 7).astype(np.uint64))) & np.uint64((1 << self.top) - 1)
            out[:, k] = self.id[key]
            at = at + self.step[key]
        return out.reshape(-1)[:n_ids]


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, str]:
    """Stage: the ids of each document in ascending order of doc_id, with its place in its partition."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, done = Encoder.shared(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch):
                ids, counts = encoder(*utf8(piece["text"]))
                raw = np.insert(ids, np.cumsum(counts), end_id).astype("<u4" if len(encoder.ids) and int(ids.max(initial=end_id)) > 0xFFFF else "<u2")
                counts = counts + 1
                ends = np.cumsum(counts)
                width = raw.dtype.itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], ends * width]).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.record_batch({"part": pa.array(np.full(len(counts), part), pa.int32()), "before": pa.array(done + ends - counts), "doc_id": piece["doc_id"], "width": pa.array(np.full(len(counts), width), pa.int32()), "ids": packed})
                done += int(ends[-1])

    return keep(ordered.mapInArrow(run, "part int, before bigint, doc_id bigint, width int, ids binary"))


def _ids(widths: np.ndarray, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of packed ids, and their number in each row."""
    buf, off = utf8(col)
    sizes = np.diff(off) // widths
    if (widths == 2).all():
        return buf.view("<u2").astype(np.uint32), sizes
    wide = [buf[a:b].view(f"<u{w}").astype(np.uint32) for a, b, w in zip(off[:-1], off[1:], widths, strict=True)]
    return np.concatenate(wide) if wide else np.empty(0, np.uint32), sizes


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs; one summed row per id and task, and at the driver one per id (the vocabulary bounds both)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids, _ = _ids(batch["width"].to_numpy(), batch["ids"])
            got = np.bincount(ids, minlength=len(total))
            got[: len(total)] += total
            total = got
        used = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    rows = tokens.select("width", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, max_bits: int = MAX_BITS, path: str | None = None) -> tuple[str, np.ndarray]:
    """Encode ``docs`` (doc_id, text) to a file of blocks in ascending doc_id order; returns its path and the code book."""
    spark = docs.sparkSession
    tokens, held = token_table(docs, tokenizer, end_id)
    lengths = code_lengths(count_ids(tokens), max_bits)
    sizes = (F.octet_length("ids") / F.col("width")).cast("bigint")
    totals = tokens.groupBy("part").agg(F.sum(sizes).alias("n")).orderBy("part").collect()  # one row per partition
    bases, n = {}, 0
    for t in totals:
        bases[t["part"]] = n
        n += t["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for batch in batches:
            for piece in slices(batch, "ids"):
                ids, counts = _ids(piece["width"].to_numpy(), piece["ids"])
                first = piece["before"].to_numpy() + np.array([bases[p] for p in piece["part"].to_pylist()])
                ends = np.cumsum(counts)
                doc_ids, rows, i = piece["doc_id"].to_pylist(), [], 0
                while i < len(counts):
                    # whole documents up to BLOCK ids, at least one, without a gap in the stream
                    lo = int(ends[i] - counts[i])
                    j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
                    gaps = np.flatnonzero(first[i + 1:j] != first[i:j - 1] + counts[i:j - 1])
                    j = i + 1 + int(gaps[0]) if len(gaps) else j
                    own = ids[lo:ends[j - 1]]
                    bits, start = encode_bits(own, codes, lengths)
                    marks = np.diff(start[::CHECK], prepend=0).astype("<u4").tobytes()
                    rows.append((int(first[i]), len(own), doc_ids[i:j], counts[i:j].tolist(), bits, marks))
                    i = j
                names = ("first", "n_ids", "doc_ids", "doc_sizes", "bits", "checkpoints")
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
                yield pa.record_batch({k: pa.array(v, t) for k, t, v in zip(names, kinds, zip(*rows, strict=True), strict=True)})

    path = path or stage_path(spark)
    tokens.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths)
    book = pa.table({"id": pa.array(used, pa.int32()), "length": pa.array(lengths[used], pa.int32())})
    spark.createDataFrame(book, CODE_SCHEMA).coalesce(1).write.parquet(f"{path}/codes")
    drop(spark, held)
    return path, lengths


def read_lengths(spark: SparkSession, path: str) -> np.ndarray:
    """The code book of a file: code lengths by id, 0 for ids not in use."""
    book = spark.read.schema(CODE_SCHEMA).parquet(f"{path}/codes").toPandas()  # one row per id
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy()] = book["length"].to_numpy()
    return lengths


def read_tokens(spark: SparkSession, path: str, lengths: np.ndarray | None = None, with_ids: bool = True) -> DataFrame:
    """The documents of a file: doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids (32-bit, little-endian).

    The code book is read from the file unless it is at hand.
    """
    lengths = read_lengths(spark, path) if lengths is None else lengths
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                block = {k: batch[k][i].as_py() for k in batch.schema.names}
                marks = np.cumsum(np.frombuffer(block["checkpoints"], "<u4").astype(np.int64))
                raw = decode(block["bits"], marks, block["n_ids"]).astype("<u4").tobytes()
                out, at = [], 0
                for doc_id, n in zip(block["doc_ids"], block["doc_sizes"], strict=True):
                    own = raw[4 * at:4 * (at + n)]
                    out.append((doc_id, block["first"] + at, n, zlib.crc32(own), own)[: len(names)])
                    at += n
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInArrow(run, schema)
