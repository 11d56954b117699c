"""Calendar keys and time blocks.

All helpers keep the type of the timestamp they are given: wall-clock
``timestamp_ntz`` in, ``timestamp_ntz`` out; zoned ``timestamp`` in,
``timestamp`` out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Meteorological seasons by month number.
SEASON_MONTHS = {
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
    "Autumn": (9, 10, 11),
    "Winter": (12, 1, 2),
}
SEASON_ORDER = ("Winter", "Spring", "Summer", "Autumn")


def season_of(ts: Column) -> Column:
    """Season name of a timestamp or date (NULL stays NULL)."""
    month = F.month(ts)
    expr = F.when(month.isin(*SEASON_MONTHS["Spring"]), "Spring")
    for name in ("Summer", "Autumn", "Winter"):
        expr = expr.when(month.isin(*SEASON_MONTHS[name]), name)
    return expr


def season_levels(spark) -> DataFrame:
    """The seasons in the order of the year: ``season`` and its ``place`` from 1, to sort and join by."""
    return spark.createDataFrame([(s, i + 1) for i, s in enumerate(SEASON_ORDER)], "season string, place int")


def temporada_of(season: Column) -> Column:
    """Two-way split of the year: summer is ``warm``, the rest ``cold``."""
    return F.when(season == "Summer", "warm").when(season.isNotNull(), "cold")


def weekday_monday(ts: Column) -> Column:
    """Weekday with Monday = 0."""
    return F.weekday(ts)


def is_ntz(df: DataFrame, ts: str) -> bool:
    return isinstance(df.schema[ts].dataType, T.TimestampNTZType)


def _as_type_of(df: DataFrame, ts: str, value: Column) -> Column:
    return value.cast("timestamp_ntz") if is_ntz(df, ts) else value.cast("timestamp")


def trunc_to(df: DataFrame, ts: str, unit: str) -> Column:
    """``date_trunc`` that keeps the column's own timestamp type."""
    return _as_type_of(df, ts, F.date_trunc(unit, F.col(ts)))


def epoch_seconds(df: DataFrame, ts: str) -> Column:
    """Elapsed whole seconds since 1970-01-01 as BIGINT."""
    if is_ntz(df, ts):
        origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("SECOND", origin, F.col(ts))
    return F.unix_seconds(F.col(ts))


def block_start(df: DataFrame, ts: str, hours: int, anchor: DataFrame | None = None) -> DataFrame:
    """Add ``window_start``: the tumbling block of ``hours`` elapsed hours.

    Blocks are anchored at the earliest timestamp of the data set truncated to
    the hour.  The anchor is a one-row aggregate used as a scalar subquery, so
    the rows themselves are never shuffled.
    """
    width = hours * 3600
    source = df if anchor is None else anchor
    earliest = source.agg(F.min(ts).alias(ts))
    start = earliest.select(trunc_to(earliest, ts, "hour").alias(ts))
    start = start.select((epoch_seconds(start, ts)).alias("anchor")).scalar()
    seconds = epoch_seconds(df, ts)
    out = df.withColumn("__anchor", start)
    back = F.pmod(seconds - F.col("__anchor"), F.lit(width))
    at = seconds - back
    if is_ntz(df, ts):
        origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        value = F.timestamp_add("SECOND", at, origin)
    else:
        value = F.timestamp_seconds(at)
    return out.withColumn("window_start", value).drop("__anchor")


def add_calendar(df: DataFrame, ts: str) -> DataFrame:
    """Hour, week, month, quarter, year, day of month, weekday, weekend, date.

    ``week`` counts complete seven-day spans from 1 January (not ISO weeks).
    """
    t = F.col(ts)
    return df.withColumns({
        "hour": F.hour(t),
        "week": (F.floor((F.dayofyear(t) - 1) / 7) + 1).cast("int"),
        "month": F.month(t),
        "quarter": F.quarter(t),
        "year": F.year(t),
        "monthday": F.dayofmonth(t),
        "weekday": F.weekday(t),
        "weekend": F.when(F.weekday(t) >= 5, "Weekend").otherwise("Working Days"),
        "date": F.to_date(t),
    })
