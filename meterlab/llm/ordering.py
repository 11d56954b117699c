"""Global order without a one-task sort: range partitions, positions in them, offsets between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .stages import keep

#: monotonically_increasing_id: the partition in the high bits, the position in it in the low 33.
POSITION_BITS = 33


def running(df: DataFrame, order: list, sums: dict[str, str] | None = None, count: str | None = None) -> tuple[DataFrame, str]:
    """Rows in the order of ``order`` with exclusive running totals over all rows.

    ``sums`` maps new columns to the (non-null) long columns they total; ``count`` names the
    0-based row number.  Rows that tie on all of ``order`` get their places arbitrarily.  The range-
    partitioned rows are written once, as range bounds differ between evaluations; after that only one
    row per partition is summed centrally.  Returns the rows and the stage's path.
    """
    spark, sums = df.sparkSession, sums or {}
    where = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", where)
    rows, path = keep(ranged)
    part = F.shiftright("__at", POSITION_BITS)
    totals = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), *[
        F.sum(v).alias(f"__{k}") for k, v in sums.items()]).orderBy("__part").collect()  # one row per partition
    n, acc = 0, dict.fromkeys(sums, 0)
    bases = []
    for t in totals:
        bases.append((t["__part"], n, *[acc[k] for k in sums]))
        n += t["__n"]
        for k in sums:
            acc[k] += t[f"__{k}"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("__part", "__rows", *[f"__base_{k}" for k in sums])])
    offsets = F.broadcast(spark.createDataFrame(bases, schema))  # bound: one row per partition
    out = rows.withColumn("__part", part).join(offsets, "__part")
    if sums:
        before = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        for k, v in sums.items():
            out = out.withColumn(k, F.col(f"__base_{k}") + F.coalesce(F.sum(v).over(before), F.lit(0)))
    if count:
        out = out.withColumn(count, F.col("__rows") + F.col("__at").bitwiseAND((1 << POSITION_BITS) - 1))
    return out.drop("__part", "__at", "__rows", *[f"__base_{k}" for k in sums]), path
