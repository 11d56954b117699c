"""Cleaning half-hourly readings and turning them into an hourly grid.

Every operator takes column names, so the same code serves readings, weather
or any other keyed series.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlab.functions.calendar import is_ntz, trunc_to
from meterlab.functions.moments import percentile
from meterlab.operators.order_stats import exact_quantiles, null_safe_join, with_stats

# The texts of the two removal motives.
MOTIVE_MISSING = "NA excess"
MOTIVE_OUTLIERS = "Outlier Excess"


def distinct_complete(df: DataFrame) -> DataFrame:
    """Rows without NULLs, exact copies removed (copies collapse map-side)."""
    return df.dropna("any").distinct()


def incomplete_share(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Percentage of rows with at least one NULL."""
    bad = None
    for c in cols or df.columns:
        bad = F.col(c).isNull() if bad is None else bad | F.col(c).isNull()
    return df.agg((F.avg(bad.cast("double")) * 100).alias("incomplete_percent"))


# --- expected slots -----------------------------------------------------------

def slot_calendar(df: DataFrame, key: str, ts: str, step: str, exempt: DataFrame | None = None) -> DataFrame:
    """Every expected slot of each key from its first to its last timestamp.

    ``step`` is an interval such as ``"30 minutes"``.  ``exempt`` is an optional
    one-column table of timestamps that are never expected.
    """
    spans = df.groupBy(key).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    slots = spans.select(key, F.explode(F.sequence("__lo", "__hi", F.expr(f"INTERVAL {step}"))).alias(ts))
    if exempt is not None:
        name = exempt.columns[0]
        slots = slots.join(exempt.select(F.col(name).alias(ts)).distinct(), ts, "left_anti")
    return slots.select(key, ts)


def daily_exempt_slots(spark, first: str, last: str) -> DataFrame:
    """One exempt timestamp per day between two timestamps (inclusive)."""
    return spark.range(1).select(
        F.explode(F.sequence(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last)),
                             F.expr("INTERVAL 1 DAY"))).alias("exempt"))


def missing_slots(df: DataFrame, key: str, ts: str, step: str, exempt: DataFrame | None = None) -> DataFrame:
    """Expected slots without a reading, one row each."""
    seen = df.select(key, ts).distinct()
    return slot_calendar(df, key, ts, step, exempt).join(seen, [key, ts], "left_anti")


def missing_slot_summary(df: DataFrame, key: str, ts: str, step: str,
                         exempt: DataFrame | None = None) -> DataFrame:
    """First and last timestamp, array and number of missing slots per key.

    The array is bounded by the calendar span of the key.
    """
    spans = df.groupBy(key).agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
    gaps = missing_slots(df, key, ts, step, exempt).groupBy(key).agg(
        F.array_sort(F.collect_list(ts)).alias("missing"), F.count(F.lit(1)).alias("n_missing"))
    out = spans.join(gaps, key, "left")
    empty = F.expr(f"CAST(array() AS array<{df.schema[ts].dataType.simpleString()}>)")
    return out.withColumns({
        "missing": F.coalesce("missing", empty),
        "n_missing": F.coalesce("n_missing", F.lit(0).cast("bigint")),
    })


def gap_fill(df: DataFrame, key: str, ts: str, step: str, exempt: DataFrame | None = None) -> DataFrame:
    """Append the missing slots; all other columns are NULL there."""
    return df.unionByName(missing_slots(df, key, ts, step, exempt), allowMissingColumns=True)


def _length(step: str) -> Column:
    return F.expr(f"CAST(INTERVAL {step} AS INTERVAL DAY TO SECOND)")


def _micros(span: Column) -> Column:
    part = lambda unit: F.extract(F.lit(unit), span)
    minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60000000 + (part("SECOND") * 1000000).cast("bigint")


def _elapsed(df: DataFrame, ts: str, start: Column, end: Column) -> Column:
    """Elapsed microseconds; a difference of zoned timestamps would follow the clock instead."""
    return _micros(end - start) if is_ntz(df, ts) else F.unix_micros(end) - F.unix_micros(start)


def mark_gaps(df: DataFrame, key: str, ts: str, step: str) -> DataFrame:
    """Add ``__gap`` and ``__upto``: how many expected slots without a reading follow a row, and no later than when.

    Slots go from a key's first timestamp to its last in steps of a fixed length (days and less).  The rows of a key
    are sorted once and each looks at the next row that stands on a slot; no calendar is built and nothing is joined.
    Of rows that share a slot one is followed by its gap, rows between slots by none.
    """
    every = Window.partitionBy(key)
    later = every.orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, -1)
    width = _micros(_length(step))
    elapsed = lambda a, b: _elapsed(df, ts, a, b)
    rows = df.withColumn("__low", F.min(ts).over(every)).withColumn("__high", F.max(ts).over(every))
    rows = rows.withColumn("__on", elapsed(F.col("__low"), F.col(ts)) % width == 0)
    rows = rows.withColumn("__next", F.last(F.when(F.col("__on"), F.col(ts)), True).over(later))
    between = F.floor(elapsed(F.col(ts), F.col("__next")) / width) - 1
    after = F.floor(elapsed(F.col(ts), F.col("__high")) / width)
    gap = F.when(F.col("__on"), F.when(F.col("__next").isNull(), after).otherwise(F.greatest(between, F.lit(0)))).otherwise(0)
    upto = F.coalesce(F.col("__next") - _length(step), F.col("__high"))  # a short step back: whole days would follow the clock
    return rows.withColumn("__gap", gap.cast("bigint")).withColumn("__upto", upto).drop("__low", "__high", "__on", "__next")


def collapse_slots(marked: DataFrame, key: str, ts: str, value: str, unit: str) -> DataFrame:
    """Rows with their gaps as one row per key, calendar unit and hour of day: sum, count and the gaps that begin there."""
    hour = F.hour(ts).alias("__hour")
    at = trunc_to(marked, ts, unit)
    gap = F.when(F.col("__gap") > 0, F.struct(F.col(ts).alias("after"), F.col("__upto").alias("upto"), F.col("__gap").alias("n")))
    return marked.groupBy(key, at.alias(ts), hour).agg(
        F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__rows"), F.collect_list(gap).alias("__gaps"))


def gap_slots(collapsed: DataFrame, key: str, ts: str, step: str, exempt: DataFrame | None = None) -> DataFrame:
    """(key, ts) of the missing slots of collapsed rows, one row each."""
    width = _length(step)
    begin = collapsed.select(key, F.explode("__gaps").alias("g"))
    slots = begin.select(key, F.explode(F.sequence(F.col("g.after") + width, F.col("g.upto"), width)).alias(ts))
    if exempt is not None:
        name = exempt.columns[0]
        slots = slots.join(exempt.select(F.col(name).alias(ts)).distinct(), ts, "left_anti")
    return slots.select(key, ts)


def fill_collapsed(collapsed: DataFrame, missing: DataFrame, key: str, ts: str, value: str, unit: str) -> DataFrame:
    """Mean per key and unit once the missing slots have got the mean of their hour of day, else the key's."""
    gaps = missing.groupBy(key, trunc_to(missing, ts, unit).alias(ts), F.hour(ts).alias("__hour")).agg(F.count(F.lit(1)).alias("__missing"))
    zero = {"__sum": F.lit(None).cast("double"), "__rows": F.lit(0).cast("bigint")}
    cells = collapsed.select(key, ts, "__hour", "__sum", "__rows", F.lit(0).cast("bigint").alias("__missing")).unionByName(gaps.withColumns(zero))
    of_hour = cells.groupBy(key, "__hour").agg(F.sum("__sum").alias("s"), F.sum("__rows").alias("n"), F.sum("__missing").alias("m"))
    day = Window.partitionBy(key)
    mean = F.try_divide("s", "n")
    weight = F.when(F.col("n") > 0, F.col("n") + F.col("m"))
    overall = F.try_divide(F.sum(mean * weight).over(day), F.sum(weight).over(day))
    fills = of_hour.withColumn("__fill", F.coalesce(mean, overall)).select(key, "__hour", "__fill")  # 24 rows a key
    filled = null_safe_join(cells, fills, [key, "__hour"], "left")
    total = F.coalesce("__sum", F.lit(0.0)) + F.when(F.col("__missing") > 0, F.col("__missing") * F.col("__fill")).otherwise(0.0)
    return filled.groupBy(key, ts).agg((F.sum(total) / F.sum(F.col("__rows") + F.col("__missing"))).alias(value))


# --- removal rules --------------------------------------------------------------

def null_rate(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(F.col(value).isNull().cast("double")).alias("pct_na"))


def removed_by_rate(rates: DataFrame, key: str, rate: str, limit: float, motive: str,
                    block: Column | str = "") -> DataFrame:
    """Audit rows ``(id_removed, block, motive)`` for keys above a limit (strict)."""
    tag = F.lit(block) if isinstance(block, str) else block
    return rates.where(F.col(rate) > limit).select(
        F.col(key).alias("id_removed"), tag.alias("block"), F.lit(motive).alias("motive"))


def keep_ids(df: DataFrame, ids: DataFrame, key: str, id_col: str = "id_removed") -> DataFrame:
    return df.join(ids.select(F.col(id_col).alias(key)).distinct(), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str, id_col: str = "id_removed") -> DataFrame:
    return df.join(ids.select(F.col(id_col).alias(key)).distinct(), key, "left_anti")


def drop_sparse(df: DataFrame, key: str, value: str, limit: float = 0.1) -> DataFrame:
    """Drop keys whose share of NULL values exceeds ``limit``."""
    removed = removed_by_rate(null_rate(df, key, value), key, "pct_na", limit, MOTIVE_MISSING)
    return drop_ids(df, removed, key)


def motive_shares(removed: DataFrame) -> DataFrame:
    """Share of each removal motive."""
    counts = removed.groupBy("motive").agg(F.count(F.lit(1)).alias("n"))
    total = removed.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select("motive", "n", F.try_divide(F.col("n"), total).alias("share"))


# --- imputation and resampling ----------------------------------------------------

def impute_hour_mean(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Fill NULLs with the key's mean at the same hour of day, else its overall mean.

    The overall mean is taken after the hourly fill, so hours weigh by all their
    rows.  Both come from one (key, hour) aggregate with at most 24 rows per key;
    rows that have a value are not joined at all.
    """
    keyed = df.withColumn("__hour", F.hour(ts))
    hourly = keyed.groupBy(key, "__hour").agg(
        F.count(F.lit(1)).alias("__rows"), F.avg(value).alias("__mean"))
    day = Window.partitionBy(key)
    weight = F.when(F.col("__mean").isNotNull(), F.col("__rows"))
    overall = F.try_divide(F.sum(F.col("__mean") * weight).over(day), F.sum(weight).over(day))
    fill = hourly.select(key, "__hour", F.coalesce("__mean", overall).alias("__fill"))
    known = df.where(F.col(value).isNotNull())
    gaps = keyed.where(F.col(value).isNull())
    filled = null_safe_join(gaps, fill, [key, "__hour"], "left").withColumn(value, F.col("__fill"))
    return known.unionByName(filled.select(*df.columns))


def downsample(df: DataFrame, key: str | list[str], ts: str, value: str | list[str],
               unit: str = "hour") -> DataFrame:
    """Mean per key and calendar unit.

    The result has one row per key and unit, so later per-key groups are bounded
    by the calendar however many raw rows a key has.
    """
    keys = [key] if isinstance(key, str) else list(key)
    values = [value] if isinstance(value, str) else list(value)
    return (df.withColumn(ts, trunc_to(df, ts, unit)).groupBy(*keys, ts)
            .agg(*[F.avg(v).alias(v) for v in values]))


# --- outliers ----------------------------------------------------------------------

def fences(q1: Column, q3: Column, k: float = 1.5) -> tuple[Column, Column]:
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def outside(x: Column, low: Column, high: Column) -> Column:
    return (x < low) | (x > high)


def flag_outliers(df: DataFrame, value: str, by: list[str], flag: str = "is_outlier") -> DataFrame:
    """Interquartile-range flag within calendar-bounded groups; NULL value -> NULL flag."""
    w = Window.partitionBy(*by)
    low, high = fences(percentile(value, .25).over(w), percentile(value, .75).over(w))
    return df.withColumn(flag, outside(F.col(value), low, high))


def outlier_rate(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of outliers among all rows of a key (one row per hour expected)."""
    return flag_outliers(df, value, [key], "__out").groupBy(key).agg(
        F.avg(F.coalesce("__out", F.lit(False)).cast("double")).alias("pct_outliers"))


def drop_outlier_heavy(df: DataFrame, key: str, value: str, limit: float = 0.1) -> DataFrame:
    removed = removed_by_rate(outlier_rate(df, key, value), key, "pct_outliers", limit, MOTIVE_OUTLIERS)
    return drop_ids(df, removed, key)


def winsorise(df: DataFrame, value: str, by: list[str] | None = None,
              caps: tuple[float, float] = (.05, .95), name: str | None = None) -> DataFrame:
    """Replace values beyond the outlier fences by the quantiles given in ``caps``.

    With ``by`` the groups may be of any size; without it the whole table is one
    group.  Either way the quantiles come from :func:`exact_quantiles`.
    """
    probs: Mapping[str, float] = {"__q1": .25, "__q3": .75, "__c0": caps[0], "__c1": caps[1]}
    stats = exact_quantiles(df, value, probs, by or ())
    joined = with_stats(df, stats, by or (), list(probs))
    low, high = fences(F.col("__q1"), F.col("__q3"))
    x = F.col(value)
    capped = F.when(x < low, F.col("__c0")).when(x > high, F.col("__c1")).otherwise(x)
    return joined.withColumn(name or value, capped).drop(*probs)


def minmax(df: DataFrame, value: str, name: str | None = None) -> DataFrame:
    """Scale a column to [0, 1] over the whole table; NULL when it is constant."""
    span = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    rows = with_stats(df, span, (), ["__lo", "__hi"])
    scaled = F.try_divide(F.col(value) - F.col("__lo"), F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)))
    return rows.withColumn(name or value, scaled).drop("__lo", "__hi")


def min_history(df: DataFrame, key: str, rows: int = 24 * 30 * 6) -> DataFrame:
    """Keep keys with at least ``rows`` rows."""
    long_enough = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= rows)
    return df.join(long_enough.select(key), key, "left_semi")


# --- dimensions ------------------------------------------------------------------

def join_weather(hourly: DataFrame, weather: DataFrame, ts: str, time: str = "time") -> DataFrame:
    """Left equi-join on the hour.

    Weather has one row per hour; Spark broadcasts it when its measured size is
    under the session threshold and shuffles both sides otherwise.
    """
    return hourly.join(weather.withColumnRenamed(time, ts), ts, "left").select(
        *hourly.columns, *[c for c in weather.columns if c != time])


def join_households(df: DataFrame, households: DataFrame, key: str, id_col: str) -> DataFrame:
    """Left equi-join with household attributes on the id."""
    return df.join(households.withColumnRenamed(id_col, key), key, "left").select(
        *df.columns, *[c for c in households.columns if c != id_col])


def key_hour_means(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Mean for every combination of key and hour of day seen in the table.

    Combinations without rows come out as NULL, as in a full product of ids and
    hours, but the product is built per key from the set of hours (at most 24).
    """
    keyed = df.select(key, F.hour(ts).alias("hour"), value)
    means = keyed.groupBy(key, "hour").agg(F.avg(value).alias(value))
    hours = keyed.agg(F.collect_set("hour").alias("h")).scalar()
    grid = keyed.select(key).distinct().withColumn("__h", hours).select(key, F.explode("__h").alias("hour"))
    return null_safe_join(grid, means, [key, "hour"], "left")
