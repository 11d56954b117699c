"""Raw half-hourly readings -> clean hourly table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlab.functions.calendar import season_of
from meterlab.operators import preparation as prep
from meterlab.sources.stages import materialise


class Cleaned(NamedTuple):
    hourly: DataFrame
    removed: DataFrame


def clean_readings(readings: DataFrame, key: str = "lc_lid", ts: str = "tstp", value: str = "energy_kwh_hh",
                   step: str = "30 minutes", unit: str = "hour", max_missing: float = 0.1,
                   max_outliers: float = 0.1, exempt: DataFrame | None = None,
                   block: str | None = None) -> Cleaned:
    """Deduplicate, fill gaps, impute, average to the unit, remove bad households.

    Gaps are found between neighbouring rows, and the readings are collapsed to one row per household, unit and hour of
    day with the gaps that begin there.  That table is written once; the removal rules, the means that fill gaps and
    the result read it, and only the gaps of households that stay are ever laid out slot by slot.
    ``exempt`` is an optional one-column table of timestamps that are never expected.
    """
    rows = prep.distinct_complete(readings.select(key, ts, value))
    cells = materialise(prep.collapse_slots(prep.mark_gaps(rows, key, ts, step), key, ts, value, unit))
    gaps = F.aggregate("__gaps", F.lit(0).cast("bigint"), lambda a, g: a + g["n"])
    counts = cells.groupBy(key).agg(F.sum("__rows").alias("n"), F.sum(gaps).alias("m"))
    if exempt is not None:
        expected = prep.gap_slots(cells, key, ts, step, exempt).groupBy(key).agg(F.count(F.lit(1)).alias("m"))
        counts = counts.drop("m").join(expected, key, "left").fillna(0, ["m"])
    share = counts.select(key, (F.col("m") / (F.col("n") + F.col("m"))).alias("pct_na"))
    sparse = prep.removed_by_rate(share, key, "pct_na", max_missing, prep.MOTIVE_MISSING)
    dense = prep.drop_ids(cells, sparse, key)
    hourly = prep.fill_collapsed(dense, prep.gap_slots(dense, key, ts, step, exempt), key, ts, value, unit)
    rates = prep.outlier_rate(hourly, key, value)
    noisy = prep.removed_by_rate(rates, key, "pct_outliers", max_outliers, prep.MOTIVE_OUTLIERS)
    removed = sparse.unionByName(noisy)
    if block is not None:
        tags = readings.groupBy(F.col(key).alias("id_removed")).agg(F.min(block).alias("__b"))
        removed = removed.join(tags, "id_removed", "left").withColumn("block", F.col("__b")).drop("__b")
    return Cleaned(prep.drop_ids(hourly, noisy, key), removed.select("id_removed", "block", "motive"))


def enrich_hourly(hourly: DataFrame, weather: DataFrame, households: DataFrame, key: str = "lc_lid",
                  ts: str = "tstp", time: str = "time", id_col: str = "LCLid") -> DataFrame:
    """Add weather, household attributes and season."""
    out = prep.join_households(prep.join_weather(hourly, weather, ts, time), households, key, id_col)
    return out.withColumn("season", season_of(F.col(ts)))
