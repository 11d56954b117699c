"""Reproducible shuffle of a table into shards: a Feistel permutation of global row numbers.

The n rows, numbered in ascending doc_id, are the first numbers of an m x m square (m is the least with
m * m >= n).  A Feistel network over pairs of residues modulo m permutes the square; a number sent outside
the n rows walks on along its cycle until it is inside.  The new number p gives shard p mod s and slot
p div s by arithmetic alone, so counts differ by at most one and slots are gapless.

Native: built-in column functions only.  Null text has no bytes (size 8, crc of no bytes); rows with equal
doc_id are numbered by their texts' checksums, and rows that tie on everything are interchangeable; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running

#: Fixed odd multipliers below 2**31, one per round; the seed shifts them.
ROUND_KEYS = (1664525013, 1103515245, 1597334677, 2024337941, 1181783497, 1540483477)
MASK31 = (1 << 31) - 1


def feistel(number: Column, side: int, keys: tuple[int, ...]) -> Column:
    """The network over one number of the square; each half is bound once so rounds don't multiply."""
    left, right = (number - number % F.lit(side)) / F.lit(side), number % F.lit(side)
    pair = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    steps = F.array(*[F.lit(k).cast("bigint") for k in keys])

    def step(acc, key):
        x = (acc["r"] * key + F.shiftright(key, 3)).bitwiseAND((1 << 62) - 1)
        x = x.bitwiseXOR(F.shiftright(x, 29)).bitwiseAND(MASK31)
        x = x * key.bitwiseXOR(F.lit(0x2545F491).cast("bigint"))
        f = F.shiftright(x, 17).bitwiseAND(MASK31) % F.lit(side)
        return F.struct(acc["r"].alias("l"), ((acc["l"] + f) % F.lit(side)).cast("bigint").alias("r"))

    return F.aggregate(steps, pair, step, lambda acc: acc["l"] * F.lit(side) + acc["r"])


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """The place of row ``number`` among ``n`` rows."""
    side = max(1, math.isqrt(max(n - 1, 0)) + 1)
    keys = tuple((k + 2 * seed) & MASK31 | 1 for k in ROUND_KEYS)
    # A cycle leaves the n rows for at most side * side - n <= 2 * side numbers in a row; on a large square
    # each step leaves them with a chance of at most 2 / side, so 64 steps in a row never happen.
    walk = F.sequence(F.lit(1), F.lit(min(2 * side + 1, 64)))
    once = feistel(number, side, keys)
    walked = F.aggregate(walk, once, lambda at, _: F.when(at < n, at).otherwise(feistel(at, side, keys)))
    return F.transform(F.array(walked), lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("the walk left the table"))))[0]


def shard(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
                         F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows, _ = running(narrow, ["doc_id", "text_crc32", "size"], count="row")
    n = rows.count()
    at = rows.withColumn("at", permuted(F.col("row"), n, seed))
    return at.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("at") % shards).cast("int").alias("shard"),
                     ((F.col("at") - F.col("at") % shards) / shards).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
