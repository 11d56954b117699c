"""Language identification by interpolated Kneser-Ney character models.

One model of order five per language, over lower-cased words with their boundaries; characters are hashed to 12
bits, so a gram is a 60-bit number.  Grams are counted over all training text; lower orders use continuation
counts, the discount of each order is n1 / (n1 + 2 n2).  The finished probabilities (stored grams) and back-off
weights (stored contexts) are sorted arrays searched by gram.  A document gets the language of the lowest cross-
entropy per character; it is rejected where that entropy lies more than ``reject`` deviations above its
language's median.  The squared deviation is that between the training documents plus that of one symbol over the
length, both by quantiles: junk with a lang label widens them little up to a tenth of a language's documents.

Grams rarer than ``rare`` of their order's counts are dropped from the finished model, which bounds it by
1 / rare grams an order and language: the model is the only thing sent to all tasks.

Null texts and texts without a letter are ``und`` (score 0, rejected); rows without lang are not trained on; with
nothing learnt all are ``und``; repeated rows count twice; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytes import mix, slices, span_hashes, spans, take_spans, utf8
from .stages import drop, keep

ORDER, BITS = 5, 12
SYMBOLS = 1 << BITS
#: Least share of an order's counts that keeps a gram in the finished model.
RARE = 2.0 ** -20
#: Grams a task holds before it passes them on.
HELD = 2 << 20
#: Words whose scores a task remembers, times the number of languages.
PLACES = 1 << 21
#: Cells of a nat in which entropies are counted; the quantile that tells their spread, and its place in a normal distribution.
CELLS, UPPER, UPPER_DEVIATION = 1000, 0.8, 0.8416
#: Least variance of a symbol, in squared nats, where most short texts of a language are alike.
LEAST_SYMBOL = 1.0
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[0x80:] = True


def held_out(modulus: int, value: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == value


def word_spans(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts, ends and text offsets of the runs of letters."""
    buf, off = utf8(pc.utf8_lower(col))
    s, e = spans(LETTER[buf], off)
    return buf, s, e, np.searchsorted(s, off)


def symbols(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words, each word ended by 0; and the number of symbols of each word."""
    size = e - s
    at = np.cumsum(size + 1) - size - 1
    flat = np.full(int(size.sum()) + len(size), 10, np.uint8)
    mask = np.ones(len(flat), bool)
    mask[at + size] = False
    flat[mask] = take_spans(buf, s, size)
    code = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    stop = np.flatnonzero(code == 10)
    folded = np.where(code < SYMBOLS - 512, code, np.uint64(SYMBOLS - 512) + mix(code) % np.uint64(512))
    folded[stop] = 0
    return folded, np.diff(stop, prepend=-1)


def grams(folded: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The gram that ends at each symbol; contexts reach back to the word's beginning, before it are zeros."""
    n = len(folded)
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = folded.copy()
    for k in range(1, ORDER):
        back = np.zeros(n, np.uint64)
        back[k:] = folded[:-k]
        back[place < k] = 0
        out |= back << np.uint64(BITS * k)
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all words of ``docs`` (text, lang); tasks sum before they send."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in held.items():
                k, c = _summed(keys, counts)
                yield pa.record_batch({"lang": pa.array([lang] * len(k), pa.string()), "gram": pa.array(k.view(np.int64)), "n": pa.array(c, pa.int64())})
            held.clear()

        for batch in batches:
            for part in slices(batch):
                buf, s, e, word_off = word_spans(part["text"])
                if not len(s):
                    continue
                codes = pc.dictionary_encode(part["lang"])
                names = codes.dictionary.to_pylist()
                of_word = np.repeat(codes.indices.to_numpy(), np.diff(word_off))
                h = span_hashes(buf, s, e)
                for i, lang in enumerate(names):
                    own = np.flatnonzero(of_word == i)
                    _, first, count = np.unique(h[own], return_index=True, return_counts=True)
                    at = own[first]
                    if not len(at):
                        continue
                    folded, sizes = symbols(buf, s[at], e[at])
                    k, c = _summed([grams(folded, sizes)], [np.repeat(count, sizes)])
                    keys, counts = held.setdefault(lang, ([], []))
                    keys.append(k)
                    counts.append(c)
                    total += len(k)
                if total > HELD:
                    for lang, (keys, counts) in held.items():
                        k, c = _summed(keys, counts)
                        held[lang] = ([k], [c])
                    total = sum(len(k[0]) for k, _ in held.values())
                    if total > HELD // 2:
                        yield from flush()
                        total = 0
        yield from flush()

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """``keys[k]`` sorted grams of order k + 1 with log probabilities, ``contexts[k]`` with log back-off weights."""

    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)  # NaN: not stored for this language
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None  # log probability of a symbol never seen

    def scores(self, gram: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last symbol in every language."""
        out = np.broadcast_to(self.floor, (len(gram), len(self.langs))).copy()
        for k in range(ORDER):
            own = gram & np.uint64((1 << BITS * (k + 1)) - 1)
            if k:
                at, hit = _search(self.contexts[k], own >> np.uint64(BITS))
                out[hit] += self.weights[k][at[hit]]
            at, hit = _search(self.keys[k], own)
            found = self.logp[k][at[hit]]
            out[hit] = np.where(np.isnan(found), out[hit], found)
        return out


def _search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def train(docs: DataFrame, rare: float = RARE) -> Model:
    """Models of all languages in ``docs`` (text, lang)."""
    spark = docs.sparkSession
    tables, paths = [], []
    table, path = keep(gram_counts(docs))
    paths.append(path)
    for k in range(ORDER, 0, -1):
        tables.append(table)
        if k > 1:  # how many different symbols stand before a gram
            mask = (1 << BITS * (k - 1)) - 1
            table, path = keep(table.groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
            paths.append(path)
    tables.reverse()
    langs = [r["lang"] for r in tables[0].select("lang").distinct().orderBy("lang").collect()]
    model = Model(langs)
    if not langs:
        drop(spark, *paths)
        return model
    lower = None
    floor = {}
    for k, rows in enumerate(tables):
        stats = {r["lang"]: r for r in rows.groupBy("lang").agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"), F.count(F.when(F.col("n") == 1, 1)).alias("n1"),
            F.count(F.when(F.col("n") == 2, 1)).alias("n2")).collect()}  # one row per language
        discount = {x: (r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5) for x, r in stats.items()}
        by_lang = F.create_map(*[F.lit(x) for p in discount.items() for x in p])
        least = F.create_map(*[F.lit(x) for p in ((i, r["total"] * rare) for i, r in stats.items()) for x in p])
        d = by_lang[F.col("lang")]
        ctx = rows.groupBy("lang", F.shiftright("gram", BITS).alias("ctx")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        ctx = ctx.withColumn("weight", d * F.col("types") / F.col("total"))
        joined = rows.withColumn("ctx", F.shiftright("gram", BITS)).join(ctx, ["lang", "ctx"])
        own = F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")
        if lower is None:
            probs = joined.withColumn("p", own + F.col("weight") / SYMBOLS)
            floor = {r["lang"]: r["weight"] / SYMBOLS for r in ctx.collect()}  # one context
        else:
            below = lower.select(F.col("lang").alias("l2"), F.col("gram").alias("g2"), F.col("p").alias("p2"))
            suffix = F.col("gram").bitwiseAND((1 << BITS * k) - 1)
            probs = joined.join(below, (F.col("lang") == F.col("l2")) & (suffix == F.col("g2"))).withColumn("p", own + F.col("weight") * F.col("p2"))
        lower, path = keep(probs.select("lang", "gram", "n", "p"))
        paths.append(path)
        kept = lower.where(F.col("n") >= least[F.col("lang")]).select("lang", "gram", "p").toPandas()  # at most 1 / rare a language
        seen = ctx.where(F.col("total") >= least[F.col("lang")]).select("lang", "ctx", "weight").toPandas()
        for frame, key, value, keys, values, empty in ((kept, "gram", "p", model.keys, model.logp, np.nan), (seen, "ctx", "weight", model.contexts, model.weights, 0.0)):
            where, slot = np.unique(frame[key].to_numpy().view(np.uint64), return_inverse=True)
            grid = np.full((len(where), len(langs)), empty, np.float32)
            grid[slot, np.searchsorted(langs, frame["lang"].to_numpy(str))] = np.log(frame[value].to_numpy())
            keys.append(where)
            values.append(grid)
    model.floor = np.log(np.array([floor[x] for x in langs])).astype(np.float32)
    drop(spark, *paths)
    return model


class _Scorer:
    """Cross-entropies of texts; the scores of recent words are kept."""

    def __init__(self, model: Model):
        self.model, n = model, max(1, len(model.langs))
        self.places = 1 << max(10, (PLACES // n).bit_length() - 1)
        self.key = np.zeros(self.places, np.uint64)
        self.value = np.zeros((self.places, n), np.float32)
        self.size = np.zeros(self.places, np.int32)

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability per symbol in each language, and the number of symbols."""
        buf, s, e, word_off = word_spans(col)
        rows = len(word_off) - 1
        h = span_hashes(buf, s, e) | np.uint64(1)
        place = (mix(h) & np.uint64(self.places - 1)).astype(np.int64)
        value, size = self.value[place], self.size[place]
        miss = np.flatnonzero(self.key[place] != h)
        if len(miss):
            _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[first]
            folded, n = symbols(buf, s[at], e[at])
            gram, again = np.unique(grams(folded, n), return_inverse=True)
            total = np.add.reduceat(self.model.scores(gram)[again], np.cumsum(n) - n, axis=0)
            value[miss], size[miss] = total[back], n[back]
            self.key[place[at]], self.value[place[at]], self.size[place[at]] = h[at], total, n
        sums, count = np.zeros((rows, value.shape[1])), np.zeros(rows, np.int64)
        full = np.flatnonzero(np.diff(word_off))
        if len(full):
            sums[full] = np.add.reduceat(value.astype(np.float64), word_off[full], axis=0)
            count[full] = np.add.reduceat(size, word_off[full])
        return -sums / np.maximum(count, 1)[:, None], count


SCORED = [T.StructField("__lang", T.IntegerType()), T.StructField("__entropy", T.DoubleType()), T.StructField("__symbols", T.LongType()), T.StructField("__score", T.DoubleType())]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the number of the best language (null: no letter), its entropy, the symbols and the posterior."""
    schema, names = T.StructType(docs.schema.fields + SCORED), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for part in slices(batch):
                text = part["text"]
                entropy, n = scorer(text)
                best = entropy.argmin(1)
                low = entropy[np.arange(len(best)), best]
                # a short or ambiguous text has a low posterior; evidence is counted up to 50 symbols
                post = 1 / np.exp(-(entropy - low[:, None]) * np.minimum(n, 50)[:, None]).sum(1)
                plain = pc.match_substring_regex(text, "[A-Za-z]").fill_null(False).to_numpy(zero_copy_only=False)
                none = np.array([not p and not (t is not None and any(map(str.isalpha, t))) for p, t in zip(plain, _odd(text, plain), strict=True)], bool)
                cols = {k: part[k] for k in names}
                cols |= {"__lang": pa.array(best.astype(np.int32), mask=none), "__entropy": pa.array(low), "__symbols": pa.array(n), "__score": pa.array(np.where(none, 0.0, post))}
                yield pa.record_batch(cols)

    return docs.mapInArrow(run, schema)


def _odd(text: pa.Array, plain: np.ndarray) -> list:
    """Only the texts without a plain letter, to look at more closely."""
    return [None] * len(plain) if plain.all() else [None if p else text[i].as_py() for i, p in enumerate(plain)]


def calibrate(scored: DataFrame, langs: list[str]) -> list[tuple[float, float, float]]:
    """Of each language over ``scored`` training rows: median entropy, and the variances between documents and of one symbol.

    Spreads are distances from the median to the ``UPPER`` quantile, so the junk that is to be rejected doesn't widen
    them.  The part of the shorter half of the documents that goes beyond the spread of all is that of their symbols.
    Equal texts count once.  Quantiles are exact over cells, of which there is a bounded number.
    """
    named = F.element_at(F.array(*[F.lit(x) for x in langs]), F.coalesce("__lang", F.lit(0)) + 1)
    true = scored.where(F.col("__lang").isNotNull() & (F.col("lang") == named)).select(
        "__lang", F.round(F.col("__entropy") * CELLS).cast("int").alias("e"), F.col("__symbols").alias("n"), "__entropy").distinct()
    true, path = keep(true.withColumn("size", F.round(F.log2("n") * 8).cast("int")))
    over = lambda rows: {r["__lang"]: r for r in rows.groupBy("__lang").agg(
        F.percentile("e", 0.5).alias("mid"), F.percentile("e", UPPER).alias("upper"), F.percentile("size", 0.5).alias("size")).collect()}  # one row per language
    rows = over(true)
    half = F.element_at(F.array(*[F.lit(rows[i]["size"] if i in rows else 0.0) for i in range(len(langs))]), F.col("__lang") + 1)
    shorter = over(true.where(F.col("size") <= half))
    drop(scored.sparkSession, path)
    out = []
    for i in range(len(langs)):
        if i not in rows:
            out.append((float("inf"), 0.0, 0.0))
            continue
        mean = rows[i]["mid"] / CELLS
        between, short = ((max(r["upper"] / CELLS - mean, 0.0) / UPPER_DEVIATION) ** 2 for r in (rows[i], shorter[i]))
        out.append((mean, between, max((short - between) * 2 ** (shorter[i]["size"] / 8), LEAST_SYMBOL)))
    return out


def verdicts(scored: DataFrame, langs: list[str], norms: list[tuple[float, float, float]], reject: float) -> DataFrame:
    """lang_pred, score and rejected in place of the raw scores."""
    if not langs:
        return scored.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)}).drop(*[f.name for f in SCORED])
    named = F.col("__lang").isNotNull()
    pick = lambda xs: F.when(named, F.element_at(F.array(*[F.lit(x) for x in xs]), F.coalesce("__lang", F.lit(0)) + 1))
    mean, between, symbol = (pick(x) for x in zip(*norms, strict=True))
    far = F.col("__entropy") - mean > reject * F.sqrt(between + symbol / F.greatest(F.col("__symbols"), F.lit(1)))
    return scored.withColumns({"lang_pred": F.coalesce(pick(langs), F.lit("und")), "score": F.coalesce("__score", F.lit(0.0)), "rejected": ~named | far}).drop(*[f.name for f in SCORED])


def identify(docs: DataFrame, training: Column, reject: float = 10.0) -> DataFrame:
    """doc_id, lang_pred, score, rejected of all rows, learnt from the rows where ``training``."""
    model = train(docs.where(training))
    narrow = docs.select("doc_id", "text", "lang", training.alias("__train"))
    rows, _ = keep(score(narrow, model).drop("text"))
    norms = calibrate(rows.where("__train"), model.langs) if model.langs else []
    return verdicts(rows, model.langs, norms, reject).drop("lang", "__train")


def keep_identified(docs: DataFrame, reject: float = 10.0) -> DataFrame:
    """``docs`` without the rows that are rejected; learnt from all rows with a lang."""
    model = train(docs)
    if not model.langs:
        return docs.limit(0)
    stats, path = keep(score(docs.select("text", "lang").where(F.col("lang").isNotNull()), model).drop("text"))
    norms = calibrate(stats, model.langs)
    drop(docs.sparkSession, path)
    return verdicts(score(docs, model), model.langs, norms, reject).where(~F.col("rejected")).select(*docs.columns)
