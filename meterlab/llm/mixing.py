"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Every source is to hold its weight's share of all words, but at most ``epochs`` times its own words.
Sources above their cap are clamped and their excess goes to the others in proportion to their weights, until
none is above.  A source's target over its words is its number of repetitions: the whole part is taken of
every document, the fraction of documents in a seeded order until the words are used up, and of the last of
these only its first words.  So each source yields its target to the word, and no document more than
``epochs`` times.

Null text has no words; a null source is a source of its own, after all others; repeated rows are documents of
their own; sources without words have target 0; an empty table gives no rows; other columns are kept by
``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running
from .stages import keep

GAPS = r"[\x20\x09-\x0D]+"
#: Copies of a source's row in the join with its documents, so that no task gets all rows of a source.
SALTS = 16


def count_words(text: Column) -> Column:
    """Number of white-space separated words, null for null text: the parts of a split but the empty ones at the ends."""
    blank = lambda c: F.when(c.isin(*"\t\n\x0b\x0c\r "), 1).otherwise(0)
    empty = F.when(text == "", 1).otherwise(blank(F.substring(text, 1, 1)) + blank(F.substring(text, -1, 1)))
    return F.when(text.isNotNull(), F.size(F.split(text, GAPS)) - empty).cast("bigint")


def water_fill(sources: DataFrame, epochs: float) -> DataFrame:
    """``sources`` (weight, source_size) with its ``target``; all rounds are sums over the sources.

    The clamped sources only grow, so the level only rises and rounds end.
    """
    sums = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()
    cap = F.col("source_size") * float(epochs)
    level, before = (sums["total"] / sums["w"] if sums["w"] else 0.0), -1.0
    while level > before:
        full = cap <= F.col("weight") * F.lit(level)
        now = sources.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("caps"),
                          F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("w")).first()
        before = level
        if now["w"]:
            level = max(level, (sums["total"] - now["caps"]) / now["w"])
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def plan(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), epochs: float = 3.0, seed: int = 7,
         keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What the mix takes of each row of ``docs`` (``keys``, size, source): also source_size, target, taken.

    Sources in code-point order, null last, have ``weights`` in turn.
    """
    order = [F.col("source").isNull(), F.col("source")]
    name = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    lot = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")
    lots, _ = running(docs.select(*keys, "source", "size", lot.alias("lot")), [*order, F.col("lot"), *[F.col(k) for k in keys], F.col("size")], {"before": "size"})
    sources, _ = keep(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked, _ = running(sources, order, {"source_before": "source_size"}, count="rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = water_fill(keep(ranked.withColumn("weight", weight))[0], epochs)
    copies = filled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "of")
    rows = lots.withColumn("salt", F.pmod(F.col("lot"), F.lit(SALTS)).cast("int"))
    joined = rows.join(copies, rows["source"].eqNullSafe(copies["of"]) & (rows["salt"] == copies["salt"]))
    goal = F.round("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, (goal - goal % F.col("source_size")) / F.col("source_size")).otherwise(0).cast("bigint")
    extra = goal - whole * F.col("source_size")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), extra - (F.col("before") - F.col("source_before"))))
    return joined.select(*keys, "source", "size", "source_size", "target", whole.alias("whole"), rest.cast("bigint").alias("rest"),
                         (whole * F.col("size") + rest).cast("bigint").alias("taken"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(count_words(F.col("text")), F.lit(0)).alias("size"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """The mixed documents, columns as in ``docs``: each as often as the plan says, and once more cut to its rest.

    The plan is made per distinct (doc_id, text, source) with the words of all its rows, and each of these rows
    gets an equal part of it, so equal rows can't be mistaken for one another.
    """
    tagged = docs.withColumn("__mix_t", F.xxhash64("text", "source"))
    sizes = tagged.groupBy("doc_id", F.col("__mix_t").alias("__t"), "source").agg(
        F.sum(F.coalesce(count_words(F.col("text")), F.lit(0))).alias("size"), F.count(F.lit(1)).alias("__n"))
    sizes, _ = keep(sizes)
    made = plan(sizes, weights, epochs, seed, ("doc_id", "__t", "__n")).select(
        F.col("doc_id").alias("__mix_id"), F.col("__t").alias("__mix_tag"), F.col("whole").alias("__mix_whole"),
        F.ceil(F.col("rest") / F.col("__n")).alias("__mix_rest"))
    joined = tagged.join(made, tagged["doc_id"].eqNullSafe(made["__mix_id"]) & (tagged["__mix_t"] == made["__mix_tag"]))
    size = F.coalesce(count_words(F.col("text")), F.lit(0))
    rests = F.when((F.col("__mix_rest") > 0) & (size > 0), F.least(F.col("__mix_rest"), size)).otherwise(0)
    copies = F.concat(F.array_repeat(size, F.col("__mix_whole").cast("int")), F.when(rests > 0, F.array(rests)).otherwise(F.array().cast("array<bigint>")))
    out = joined.withColumn("__mix_take", F.explode(copies))
    words = F.filter(F.split("text", GAPS), lambda w: w != "")
    cut = F.array_join(F.slice(words, 1, F.col("__mix_take").cast("int")), " ")
    text = F.when(F.col("__mix_take") < size, cut).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)
