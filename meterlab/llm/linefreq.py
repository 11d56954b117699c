"""Quality rules and cross-document line frequency.

Lines that stand in too many documents of one host (navigation, licences, disclaimers) are removed: more than
``min_docs`` documents and more than ``share`` of the host's, which tells in small hosts, or more than ``always``
documents whatever the host's size (None: no such limit, so that a line must stand in more documents the larger its
host is).  A document is rejected if its base rules fail or if the removal depletes it: fewer than ``min_words``
words left, or less than ``min_left`` of its words.

Native: built-in column functions only.  Lines are compared by the hash of (host, lower-cased line with single
blanks); a line counts once per document.  Null text has no words (its base rule fails); null hosts are one
host; repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import GAPS, count_words
from .stages import keep

SYMBOLS, VISIBLE = "[#*$%&|<>]", r"[^\x20\x09-\x0D]"
#: Copies of a frequent line in the join with the documents, so that no task gets all rows of one line.
SALTS = 16


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAPS), lambda w: w != "")


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words in windows of ``width`` words that stand twice or more in the list, the first included."""
    def covered(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            return F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))

        starts = F.sort_array(F.transform(bound(at, twins), lambda x: x["i"]))
        return bound(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x))

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) < width, 0).otherwise(
            bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))

    return bound(words, count)


def base_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``__host`` and ``__lines`` (hash and words of each line with a word)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(VISIBLE))
    key = lambda x: F.xxhash64(F.col(host), F.trim(F.regexp_replace(F.lower(x), GAPS, " ")))
    found = docs.select(
        "doc_id", F.col(host).alias("__host"), count_words(text).alias("n_words"),
        F.length(F.regexp_replace(text, GAPS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(words_of(text)).cast("bigint").alias("n_repeat_words"),
        F.transform(lines, lambda x: F.struct(key(x).alias("key"), count_words(x).cast("int").alias("n"))).alias("__lines"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return found.withColumn("base_failed", failed)


def line_frequency(docs: DataFrame, host: str = "source", min_docs: int = 2, share: float = 0.05, min_words: int = 10,
                   min_left: float = 0.3, always: int | None = 50) -> DataFrame:
    """The counts and verdicts of every document: n_left is what the removal of frequent lines leaves."""
    rules, _ = keep(base_rules(docs, host).withColumn("__row", F.monotonically_increasing_id()))
    seen = rules.select("__host", F.explode(F.array_distinct(F.transform("__lines", lambda x: x["key"]))).alias("key"))
    often = seen.groupBy("__host", "key").count().where(F.col("count") > (min_docs if always is None else min(min_docs, always)))
    hosts = rules.groupBy(F.col("__host").alias("__of")).agg(F.count(F.lit(1)).alias("__docs"))
    frequent = (F.col("count") > min_docs) & (F.col("count") > F.col("__docs") * share)
    if always is not None:
        frequent = frequent | (F.col("count") > always)
    limited = often.join(hosts, often["__host"].eqNullSafe(hosts["__of"])).where(frequent)
    common = limited.select(F.col("key").alias("__key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    lines = rules.select("__row", F.explode("__lines").alias("x")).select("__row", F.col("x.key").alias("key"), F.col("x.n").alias("n"))
    cut = (lines.join(common, (lines["key"] == common["__key"]) & (F.pmod("__row", F.lit(SALTS)) == common["__salt"]), "left_semi")
           .groupBy("__row").agg(F.sum("n").alias("__cut")))
    left = F.col("n_words") - F.coalesce("__cut", F.lit(0))
    depleted = (left < min_words) | (left < F.col("n_words") * min_left)
    return (rules.drop("__lines", "__host").join(cut, "__row", "left").withColumn("n_left", left.cast("bigint"))
            .withColumn("kept", ~F.col("base_failed") & ~depleted).drop("__row", "__cut"))
