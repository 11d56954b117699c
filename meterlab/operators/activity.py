"""Activity at home from the variance of standardised energy in 6-hour blocks.

Inputs are hourly (one row per household and hour), so every window below is
bounded by the calendar; all of them share the household partitioning and
therefore one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlab.functions.calendar import block_start, season_of
from meterlab.functions.moments import percentile, zscore_over


def zscore(df: DataFrame, value: str, by: list[str], name: str | None = None, strict: bool = False) -> DataFrame:
    """Standardise within each group (mean, sample standard deviation)."""
    return df.withColumn(name or value, zscore_over(value, Window.partitionBy(*by), strict))


def _standardised_blocks(hourly: DataFrame, key: str, ts: str, value: str, hours: int) -> DataFrame:
    z = zscore(hourly, value, [key], "__z", strict=True)
    if "season" not in z.columns:
        z = z.withColumn("season", season_of(F.col(ts)))
    return block_start(z, ts, hours, anchor=hourly)


def block_variance(hourly: DataFrame, key: str, ts: str, value: str, hours: int = 6) -> DataFrame:
    """Sample variance per (household, block, season); NULL for a one-row block."""
    return (_standardised_blocks(hourly, key, ts, value, hours)
            .groupBy(key, "window_start", "season").agg(F.var_samp("__z").alias("block_variance")))


def activity_threshold(blocks: DataFrame, key: str, p: float = 0.1) -> DataFrame:
    """Low quantile of block variance per household and season, NULL blocks ignored."""
    return (blocks.where(F.col("block_variance").isNotNull())
            .groupBy(key, "season").agg(percentile("block_variance", p).alias("threshold")))


def detect_home(hourly: DataFrame, key: str, ts: str, value: str, hours: int = 6, p: float = 0.1,
                keep_block: bool = False) -> DataFrame:
    """Add ``is_home``: block variance (NULL counts as 0) reaches the threshold.

    The variance enters the quantile once per block: only the first row of a
    block carries it into the (household, season) window.
    """
    rows = _standardised_blocks(hourly, key, ts, value, hours)
    block = Window.partitionBy(key, "season", "window_start")
    season = Window.partitionBy(key, "season")
    rows = (rows.withColumn("__var", F.var_samp("__z").over(block))
            .withColumn("__first", F.row_number().over(block.orderBy(ts)) == 1)
            .withColumn("__limit", percentile(F.when(F.col("__first"), F.col("__var")), p).over(season))
            .withColumn("is_home", F.coalesce("__var", F.lit(0.0)) >= F.col("__limit")))
    extra = ["window_start"] if keep_block else []
    season_col = [] if "season" in hourly.columns else ["season"]
    return rows.select(*hourly.columns, *season_col, *extra, "is_home")
