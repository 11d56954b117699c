"""Audit of how the sources of each language diverge in their terms, by chunk factorization.

Chunks are white-space separated; no term crosses one.  Chunks are counted per document, and their counts go to the
bucket of the chunk, where each globally distinct chunk is tokenized once and its terms are joined back to the counts
of its (lang, source) groups.  These go on to the bucket of the term, which adds up occurrences and tells distinct
documents apart.  A term is kept in a language if at least ``min_docs`` of the language's documents hold it.  Kept terms
give every group and every language a smoothed share in parts of a billion, and shares are compared by the whole-number
chi-square term ``f(p, q) = (p - q)^2 div q``.

Distinct documents: a chunk's count carries its number of documents in the group, and the first and last of them,
merged by sum, minimum and maximum.  A chunk in three or more documents settles its terms; otherwise first and last
name all of its documents, and the term's distinct names are counted.  So ``min_docs`` is 3 at most, and no list of
documents is ever gathered.

The result has a row per ordered pair of sources of a language, so the sources of one language are taken to be few
enough for that; terms and documents are not bounded.

Null text, lang and source are ''; repeated rows are documents of their own; a group without terms has count 0
everywhere; a language without kept terms has pair values 0; an empty table gives no rows; other columns are ignored.
"""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytes import GAP, LOWER, ranges, slices, spans, utf8, words
from .stages import keep
from .tallies import PACKED, merged, n_buckets, pack, strings, whole

#: Bytes of terms: ASCII letters and everything outside ASCII.
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
#: Bytes of text in which chunks are counted at once.
SLICE = 3 << 20
#: Terms times sources compared in one group of the comparison.
CELLS = 1 << 20
COUNTS = ["n", "docs", "first", "last"]


def _count_chunks(buckets: int):
    """Occurrences, documents, first and last document of each chunk and group of a slice of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                buf, off = utf8(part.column("text"))
                start, end, at = words(buf, off)
                if not len(start):
                    continue
                chunks = strings(buf[~GAP[buf]], end - start).dictionary_encode()
                lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                n_sources = len(source.dictionary)
                labels = [json.dumps([x, y]) for x in lang.dictionary.to_pylist() for y in source.dictionary.to_pylist()]
                group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
                order = np.argsort(group, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))  # documents of a group stand together
                doc = np.repeat(place, np.diff(at))
                pairs, n = np.unique(chunks.indices.to_numpy().astype(np.int64) * len(order) + doc, return_counts=True)
                code, doc = pairs // len(order), order[pairs % len(order)]
                owner, row = group[doc], part.column("row").to_numpy()[doc]
                head = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])]))
                yield pack(chunks.dictionary.take(pa.array(code[head])), owner[head], labels,
                           [np.add.reduceat(n, head), np.diff(np.append(head, len(code))), np.minimum.reduceat(row, head),
                            np.maximum.reduceat(row, head)], buckets)

    return run


def _tokenize_chunks(buckets: int):
    """Every distinct chunk of a bucket is tokenized once; its terms get the counts of the chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = merged(batches, COUNTS, {"n": "sum", "docs": "sum", "first": "min", "last": "max"})
        table = held.table()
        chunks = whole(table.column("text")).dictionary_encode()
        buf, off = utf8(chunks.dictionary)
        start, end = spans(TERM[buf], off)
        if not len(start):
            return
        terms = strings(LOWER[buf[TERM[buf]]], end - start)
        edge = np.searchsorted(start, off)
        code = chunks.indices.to_numpy()
        times = np.diff(edge)[code]
        term, entry = ranges(edge[:-1][code], times), np.repeat(np.arange(len(code)), times)
        ints = [table.column(c).to_numpy()[entry] for c in COUNTS]
        yield pack(terms.take(pa.array(term)), table.column("label").to_numpy()[entry], held.labels, ints, buckets)

    return run


def _keep_terms(min_docs: int):
    """Occurrences per group of the terms that enough documents of the language hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = merged(batches, COUNTS, None)
        table = held.table()
        groups = [json.loads(x) for x in held.labels]
        names = sorted({x for x, _ in groups})
        lang = np.array([names.index(x) for x, _ in groups])
        terms = whole(table.column("text")).dictionary_encode()
        label, code = table.column("label").to_numpy(), terms.indices.to_numpy().astype(np.int64)
        n, docs, first, last = (table.column(c).to_numpy() for c in COUNTS)
        word = code * len(names) + lang[label]  # the term of a language
        sure = np.zeros(len(terms.dictionary) * len(names), bool)
        sure[word[docs >= min_docs]] = True
        few = np.flatnonzero(~sure[word])
        owner, name = np.concatenate([word[few], word[few]]), np.concatenate([first[few], last[few]])
        order = np.lexsort((name, owner))
        owner, name = owner[order], name[order]
        new = np.append(True, (owner[1:] != owner[:-1]) | (name[1:] != name[:-1]))[:len(owner)]
        sure |= np.bincount(owner[new], minlength=len(sure)) >= min_docs
        kept = np.flatnonzero(sure[word])
        groups_of, back = np.unique(code[kept] * len(groups) + label[kept], return_inverse=True)
        total = np.zeros(len(groups_of), np.int64)
        np.add.at(total, back, n[kept])
        label = groups_of % len(groups)
        yield pa.record_batch([pa.array([x for x, _ in groups], pa.string()).take(pa.array(label)), pa.array([y for _, y in groups], pa.string()).take(pa.array(label)),
                               terms.dictionary.take(pa.array(groups_of // len(groups))), total], names=["lang", "source", "term", "n"])

    return run


def kept_counts(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """lang, source, term, n: occurrences of the terms that at least ``min_docs`` documents of the language hold."""
    if not 1 <= min_docs <= 3:
        raise ValueError("min_docs must be 1, 2 or 3")
    buckets = n_buckets(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    text = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")], F.monotonically_increasing_id().alias("row"))
    chunks = text.mapInArrow(_count_chunks(buckets), PACKED)
    terms = chunks.groupBy("bucket").applyInArrow(_tokenize_chunks(buckets), PACKED)
    return terms.groupBy("bucket").applyInArrow(_keep_terms(min_docs), "lang string, source string, term string, n long")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exact for totals below 9 * 10^15, by long division in thousands."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def _compare(top: int):
    """Compare the terms of one bucket of a language between all its sources."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(counts: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("source")
        names, lang = groups.column("source").combine_chunks(), groups.column("lang")[0].as_py()
        total, kept = groups.column("total").to_numpy(), int(groups.column("kept")[0].as_py())
        terms = pc.unique(counts.column("term")).sort() if counts.num_rows else pa.array([], pa.string())
        n = np.zeros((len(terms), len(names)), np.int64)
        if counts.num_rows:
            n[pc.index_in(counts.column("term"), terms).to_numpy(), pc.index_in(counts.column("source"), names).to_numpy()] = counts.column("n").to_numpy()
        p = shares(n, np.maximum(total + kept, 1)) if kept else n
        of_lang = shares(n.sum(axis=1), np.maximum(total.sum() + kept, 1)) if kept else n.sum(axis=1)
        parts = []

        def add(i, part, items, values):
            k = len(values)
            parts.append(pa.table([pa.array([lang] * k, pa.string()), pa.array([names[i].as_py()] * k, pa.string()), pa.array([part] * k, pa.string()),
                                   items, pa.array(values, pa.int64())], schema=schema))

        for i in range(len(names)):
            others = np.flatnonzero(np.arange(len(names)) != i)
            values = np.zeros(len(others), np.int64)
            for block in np.array_split(others, max(1, len(others) * len(terms) // CELLS)):
                q = p[:, block]
                d = p[:, i:i + 1] - q
                values[np.searchsorted(others, block)] = (d * d // q).sum(axis=0) if len(terms) else 0
            add(i, "pair", names.take(pa.array(others)), values)
            above = np.flatnonzero((n[:, i] > 0) & (p[:, i] > of_lang))
            d = p[above, i] - of_lang[above]
            f = d * d // of_lang[above]
            first = np.lexsort((above, -f))[:top]  # terms are sorted by bytes
            add(i, "term", terms.take(pa.array(above[first])), f[first])
        return pa.concat_tables(parts)

    return run


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by divergence, and the ``top`` terms
    that a source holds more than its language does."""
    kept, _ = keep(kept_counts(docs, min_docs))
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = named.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])
    langs = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups, _ = keep(groups.join(langs, "lang", "left").fillna(0, ["kept"]))
    buckets = F.ceil((F.first("kept") * F.count(F.lit(1)) + 1) / CELLS).cast("int").alias("buckets")
    sizes = groups.groupBy("lang").agg(buckets)
    copies = groups.join(sizes, "lang").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    dealt = kept.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), "buckets").cast("int").alias("bucket"), "term", "source", "n")
    parts = (dealt.groupBy("lang", "bucket").cogroup(copies.groupBy("lang", "bucket"))
             .applyInArrow(_compare(top), "lang string, source string, part string, item string, value long"))
    values = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return values.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
