"""Phrase collocations of each language by best-first branch-and-bound growth.

A phrase of 2 to ``longest`` words scores ``floor(2000000 a / (l + r))`` at its lowest-scoring cut, where a, l, r count the
phrase, its first part and its rest.  An extension stands at most as often as what it extends, and its cut after the
first word has the first word's count on the left, so ``2000000 a / (count of the first word + a)`` bounds the scores
of all phrases that begin with a phrase; likewise with the last word for those that end with it.

Words and pairs are counted first.  The ``width`` best pairs of a language set its threshold; only phrases whose bound
reaches it are grown, by one counting pass per length, and all their extensions of one word on either side are counted,
as these decide whether a phrase is dropped.  (A longer phrase that covers one by two words holds one that covers it by
one word and stands at least as often.)  Where fewer than ``limit`` phrases survive at or above the threshold, the
language's width is multiplied and its frontier grown again, down to threshold 0; otherwise the last rank and its
ties are settled, since whatever wasn't grown scores less.

Passes pick phrases through bit maps of hashed phrases of a bounded size (``BITS_MOST``): a full map costs counts of
phrases that don't matter, never a wrong one, as phrases are counted and joined as strings.

Null text is empty; null lang is ``und``; repeated rows count again; an empty table, or one without candidates, gives
no rows; other columns are ignored.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytes import BASE, LOWER, U64, mix, slices, span_hashes, spans, take_spans, utf8
from .stages import keep
from .tallies import PACKED, merged, n_buckets, pack, strings, whole

#: Marks that end a piece, and what separates words in it.
MARK = np.zeros(256, bool)
MARK[[*b".,;:!?", 10, 11, 12, 13]] = True
WORD = ~MARK
WORD[[9, 32]] = False
#: Bytes of text in which phrases are counted at once.
SLICE = 4 << 20
#: Bits of a map of phrases (powers of two): bits per phrase, and at most 64 MB in all.
BITS_EACH, BITS_LEAST, BITS_MOST = 16, 1 << 20, 1 << 29
PAGE = 1 << 15
COUNTED = "lang string, phrase string, a long"
MILLIONS = 2_000_000


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words one after the other, a blank after each: bytes, starts, ends; whether the next is in the same piece; row."""
    buf, off = utf8(part.column("text"))
    rows = np.arange(len(off) - 1)
    own = np.full(len(buf) + len(off), 10, np.uint8)  # a mark around each text
    own[np.arange(len(buf)) + np.repeat(rows + 1, np.diff(off))] = LOWER[buf]
    word = WORD[own]
    after = ~word & np.concatenate([[False], word[:-1]])
    first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    own[after & ~MARK[own]] = 32
    marks = np.cumsum(MARK[own])[first]
    row = np.repeat(rows, np.diff(np.searchsorted(first, off + np.arange(len(off)))))
    own[after] = 32
    flat = own[word | after]
    end = np.flatnonzero(flat == 32)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    return flat, start, end, np.append(marks[1:] == marks[:-1], False)[:len(end)], row


def _hashes(words: np.ndarray, k: int, lang: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``k`` words that begin at each word (the last k - 1 have none)."""
    out = words[:len(words) - k + 1].copy()
    for j in range(1, k):
        out = mix(out * U64(BASE) + words[j:len(words) - k + 1 + j])
    return mix(out ^ lang[:len(out)])


class Map:
    """A set of phrases as bits of their hashes; may hold more than was put in."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        h = h & U64(len(self.bits) * 8 - 1)
        return (self.bits[(h >> U64(3)).astype(np.int64)] >> (h & U64(7)).astype(np.uint8)) & 1 == 1


def phrase_map(phrases: DataFrame, n: int, size: int) -> Map:
    """The map of ``n``-word phrases (lang, phrase), ``size`` of them; at most ``BITS_MOST`` bits reach the driver."""
    bits = min(BITS_MOST, max(BITS_LEAST, 1 << (size * BITS_EACH).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                buf, off = utf8(batch.column("phrase"))
                start, end = spans(buf != 32, off)
                words = span_hashes(buf, start, end)
                lang_buf, lang_off = utf8(batch.column("lang"))
                lang = span_hashes(lang_buf, lang_off[:-1], lang_off[1:])
                h = _hashes(words, n, np.repeat(lang, n))[::n] & U64(bits - 1)
                yield pa.record_batch({"h": h.astype(np.int64)})

    pages = (phrases.select("lang", "phrase").mapInArrow(run, "h long").groupBy(F.shiftright("h", 15).alias("page"))
             .agg(F.bitmap_construct_agg(F.col("h") % PAGE).alias("bits")).collect())
    out = np.zeros(bits // 8, np.uint8)
    for page in pages:
        out[page["page"] * PAGE // 8:(page["page"] + 1) * PAGE // 8] = np.frombuffer(page["bits"], np.uint8)
    return Map(out)


def count_phrases(docs: DataFrame, k: int, buckets: int, least: int, want=None) -> DataFrame:
    """lang, phrase, a: the phrases of ``k`` words that stand ``least`` times or more within pieces.

    ``want(hash)`` picks the places at which a phrase is counted: ``hash(j)`` are the
    hashes of the ``j``-word runs that begin at each place.  For single words, null phrases give parts of the number of words.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                flat, start, end, same, row = _words(part)
                n = len(start) - k + 1
                if n <= 0:
                    continue
                lang = part.column("lang").dictionary_encode()
                code = lang.indices.to_numpy().astype(np.int64)[row]
                ok = np.ones(n, bool)
                for j in range(k - 1):
                    ok &= same[j:j + n]
                if want is not None:
                    lang_buf, lang_off = utf8(lang.dictionary)
                    of_lang = span_hashes(lang_buf, lang_off[:-1], lang_off[1:])[code]
                    words = span_hashes(flat, start, end)
                    ok &= want(lambda j: _hashes(words, j, of_lang))  # noqa: B023
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                size = end[at + k - 1] - start[at]
                found = strings(flat[flat != 32] if k == 1 and len(at) == len(start) else take_spans(flat, start[at], size), size).dictionary_encode()
                pairs, a = np.unique(found.indices.to_numpy().astype(np.int64) * len(lang.dictionary) + code[at], return_counts=True)
                yield pack(found.dictionary.take(pa.array(pairs // len(lang.dictionary))), pairs % len(lang.dictionary), lang.dictionary.to_pylist(), [a], buckets)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = merged(batches, ["a"], {"a": "sum"})
        table = held.table()
        a, label = table.column("a").to_numpy(), table.column("label").to_numpy()
        names = pa.array(held.labels, pa.string())
        often = np.flatnonzero(a >= least)
        yield pa.record_batch([names.take(pa.array(label[often])), whole(table.column("text")).take(pa.array(often)), pa.array(a[often])], names=["lang", "phrase", "a"])
        if k == 1:
            total = np.zeros(len(names), np.int64)
            np.add.at(total, label, a)
            yield pa.record_batch([names, pa.nulls(len(names), pa.string()), pa.array(total)], names=["lang", "phrase", "a"])

    return docs.mapInArrow(count, PACKED).groupBy("bucket").applyInArrow(finish, COUNTED)


def _floor_ratio(a: str, below: str) -> Column:
    return F.expr(f"(cast({a} as decimal(19,0)) * {MILLIONS}) div cast({below} as decimal(20,0))")


def scored(phrases: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """lang, phrase, a, l, r, score, first, last: the lowest-scoring cut, and the counts of the first and the last word.

    ``known`` (lang, phrase, a) has the parts; phrases of which a part is missing have a null score.
    """
    w = F.split("phrase", " ")
    parts = F.array(*[F.struct(F.lit(j).alias("cut"), F.lit(side).alias("side"), F.array_join(F.slice(w, *place), " ").alias("part"))
                      for j in range(1, k) for side, place in (("l", (1, j)), ("r", (j + 1, k - j)))])
    rows = phrases.select("lang", "phrase", "a", F.explode(parts).alias("p")).select("lang", "phrase", "a", "p.*")
    of = known.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__part"), F.col("a").alias("f"))
    found = rows.join(of, (rows["lang"] == of["__lang"]) & (rows["part"] == of["__part"]), "left")
    pick = lambda j, side: F.max(F.when((F.col("cut") == j) & (F.col("side") == side), F.col("f")))
    wide = found.groupBy("lang", "phrase", "a").agg(*[pick(j, side).alias(f"{side}{j}") for j in range(1, k) for side in "lr"])
    cuts = F.array(*[F.struct(_floor_ratio("a", f"l{j} + r{j}").alias("score"), F.lit(j).alias("cut"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r"))
                     for j in range(1, k)])
    least = F.when(reduce(lambda x, y: x & y, [F.col(f"{s}{j}").isNotNull() for j in range(1, k) for s in "lr"]), F.array_min(cuts))
    return (wide.withColumn("__cut", least)
            .select("lang", "phrase", "a", F.col("__cut.l").alias("l"), F.col("__cut.r").alias("r"), F.col("__cut.score").alias("score"),
                    F.col("l1").alias("first"), F.col(f"r{k - 1}").alias("last")))


def _reaching(table: DataFrame, tau: DataFrame) -> DataFrame:
    """The table with its languages' thresholds and whether score, beginning and end bound reach them."""
    out = table.join(tau, "lang")
    reach = lambda x: F.coalesce(x >= F.col("tau"), F.lit(False))
    return out.select("lang", "phrase", reach(F.col("score")).alias("scores"), reach(_floor_ratio("a", "first + a")).alias("begins"),
                      reach(_floor_ratio("a", "last + a")).alias("ends"))


def _maps(table: DataFrame, k: int, kinds: tuple[str, ...]) -> dict[str, Map]:
    sizes = table.agg(*[F.count_if(F.col(c)).alias(c) for c in kinds]).first()
    return {c: phrase_map(table.where(c), k, sizes[c]) for c in kinds}


def collocations(docs: DataFrame, least: int = 30, limit: int = 2000, cover: int = 80, width: int = 4000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``limit`` best phrases of 2 to 4 words of each language that no longer
    candidate covers with ``cover`` percent of their count."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = n_buckets(total)
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    ones, _ = keep(count_phrases(text, 1, buckets, least))
    words = ones.where(F.col("phrase").isNotNull())
    n_words = ones.where(F.col("phrase").isNull()).groupBy("lang").agg(F.sum("a").alias("n"))
    known1 = phrase_map(words, 1, words.count())
    twos, _ = keep(count_phrases(text, 2, buckets, least, lambda h: _both(known1.holds(h(1)))))
    pairs, _ = keep(scored(twos, words, 2))
    every = phrase_map(twos, 2, twos.count())
    best = pairs.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"))))
    settled = None
    while True:
        now = best.where(F.col("place") <= width).groupBy("lang").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("tau"))
        tau = now.select("lang", F.when(F.col("held") < width, 0).otherwise(F.col("tau")).alias("tau"))
        if settled is not None:
            tau = tau.join(settled.select("lang", F.col("tau").alias("old"), "enough"), "lang", "left").select(
                "lang", F.when(F.col("enough"), F.col("old")).otherwise(F.col("tau")).alias("tau"))
        tau, _ = keep(tau)
        at2 = _maps(_reaching(pairs, tau), 2, ("begins", "ends"))

        def three(h, at2=at2):
            two = h(2)
            known = every.holds(two)
            return known[:-1] & known[1:] & (at2["begins"].holds(two[:-1]) | at2["ends"].holds(two[1:]))

        threes, _ = keep(count_phrases(text, 3, buckets, least, three))
        triples, _ = keep(scored(threes, words.unionByName(twos), 3))
        at3 = _maps(_reaching(triples, tau), 3, ("begins", "ends", "scores"))

        def four(h, at3=at3):
            known, triple = every.holds(h(2)), h(3)
            scores, begins, ends = (at3[c].holds(triple) for c in ("scores", "begins", "ends"))
            return known[:-2] & known[1:-1] & known[2:] & (scores[:-1] | scores[1:] | (begins[:-1] & ends[1:]))

        fours, _ = keep(count_phrases(text, 4, buckets, least, four))
        quads = scored(fours, words.unionByName(twos).unionByName(threes), 4)
        w = F.split("phrase", " ")
        inside = lambda t, k: t.select("lang", "a", F.explode(F.array(*[F.array_join(F.slice(w, i, k - 1), " ") for i in (1, 2)])).alias("phrase"))
        covers = inside(threes, 3).unionByName(inside(fours, 4)).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        candidates = reduce(DataFrame.unionByName, [t.select("lang", "phrase", "a", "l", "r", "score") for t in (pairs, triples, quads)])
        reached = candidates.join(tau, "lang").where(F.col("score") >= F.col("tau"))
        hidden = F.expr(f"cast(longer as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {int(cover)}")
        alive, _ = keep(reached.join(covers, ["lang", "phrase"], "left").where(~F.coalesce(hidden, F.lit(False))).drop("longer"))
        survivors = alive.groupBy("lang").agg(F.count(F.lit(1)).alias("alive"))
        settled, _ = keep(tau.join(survivors, "lang", "left").select(
            "lang", "tau", ((F.col("tau") == 0) | (F.coalesce("alive", F.lit(0)) >= limit)).alias("enough")))
        if settled.where(~F.col("enough")).isEmpty():
            break
        width *= 4
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return (alive.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= limit).join(n_words, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def _both(known: np.ndarray) -> np.ndarray:
    return known[:-1] & known[1:]
