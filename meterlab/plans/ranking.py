"""Clean hourly table -> stationary table -> ranking and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlab.functions.calendar import season_of, temporada_of
from meterlab.functions.moments import zscore_over
from meterlab.operators import bootstrap, dependence
from meterlab.operators.activity import detect_home
from meterlab.operators.preparation import min_history
from meterlab.operators.profiles import box_stats, kernel_density, mean_by
from meterlab.operators.stationary import drop_heavily_imputed, numeric_columns, stationarise
from meterlab.sources.stages import materialise


def stationary_table(hourly: DataFrame, key: str, ts: str, energy: str, weather: Sequence[str],
                     min_rows: int = 24 * 30 * 6, **options) -> DataFrame:
    """Home detection, minimum history, then stationary series masked to time at home."""
    active = detect_home(min_history(hourly, key, min_rows), key, ts, energy)
    return stationarise(active, [key], ts, energy, [energy, *weather], is_home="is_home", **options)


def household_ranking(stationary: DataFrame, key: str, ts: str, x: str, y: str, k: int = 24,
                      method: str = "spearman", by_seasons: bool = True,
                      keep: DataFrame | None = None) -> DataFrame:
    """Rank households by the GCC of their typical weeks, per cold/warm season or overall."""
    rows = stationary if keep is None else stationary.join(keep, key, "left_semi")
    scores = materialise(dependence.gcc_by_household(rows, key, ts, x, y, k, method, by_seasons))
    return dependence.rank_households(scores, ["temporada"] if by_seasons else [])


def gcc_profile(ranking: DataFrame, by: str, groups: Sequence[str] | None = None, value: str = "gcc",
                points: int = 512) -> tuple[DataFrame, DataFrame]:
    """Box statistics and kernel density of the GCC per group of an enriched ranking."""
    rows = ranking if groups is None else ranking.where(F.col(by).isin(*groups))
    rows = materialise(rows.select(by, value))
    return box_stats(rows, value, [by]), kernel_density(rows, value, [by], points)


def daily_stationary(population: DataFrame, ts: str, energy: str, transformation: str = "mstl",
                     key: Sequence[str] = (), cols: Sequence[str] | None = None, **options) -> DataFrame:
    """Daily, standardised version of one population-mean series per key, with season labels.

    ``population`` has one row per key and hour (or day), a calendar-bounded table.
    """
    cols = list(cols) if cols is not None else numeric_columns(population, exclude=list(key))
    keys = list(key)
    work = population
    if not keys:
        work, keys = population.withColumn("__series", F.lit(0)), ["__series"]
    still = stationarise(work, keys, ts, energy, cols, transformation=transformation, **options)
    day = mean_by(still.withColumn("date", F.to_date(ts)), [*keys, "date"], cols)
    day = day.withColumns({c: zscore_over(c, Window.partitionBy(*keys)) for c in cols})
    day = day.withColumn("season", season_of(F.col("date")))
    day = day.withColumn("temporada", temporada_of(F.col("season")))
    return day.drop("__series")


def bootstrap_interval(daily: DataFrame, x: str, y: str, key: Sequence[str] = (), replicates: int = 10000,
                       k: int = 7, alpha: float = 0.05, by_seasons: bool = True, seed: int = 123) -> DataFrame:
    """Block-bootstrap percentile interval of the GCC, per cold/warm season or overall."""
    keys = [*key, *(["temporada"] if by_seasons else [])]
    work = daily
    if not keys:
        work, keys = daily.withColumn("__series", F.lit(0)), ["__series"]
    placed = work.withColumn("__pos", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
    samples = materialise(bootstrap.block_bootstrap_pairs(placed, keys, "__pos", [(x, y)], replicates, k, seed=seed))
    return bootstrap.percentile_ci(samples, keys, alpha).drop("__series")


def pair_samples(daily: DataFrame, seasonal: Sequence[tuple[str, str]], overall: Sequence[tuple[str, str]],
                 replicates: int = 10000, k: int = 7, seed: int = 123, digits: int | None = 9) -> DataFrame:
    """Bootstrap scores ``(temporada, replicate, pair, gcc, valid)`` of one daily stationary series.

    ``seasonal`` pairs are drawn within the cold and the warm season, ``overall`` pairs from all days (``temporada``
    is then "all").  ``digits`` rounds the values, so that means equal up to float noise are ties.
    """
    names = list(dict.fromkeys(c for p in (*seasonal, *overall) for c in p))
    days = daily.select("date", "temporada", *[(F.col(c) if digits is None else F.round(c, digits)).alias(c) for c in names])
    days = materialise(days)

    def drawn(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
        placed = rows.withColumn("__pos", F.row_number().over(Window.partitionBy("temporada").orderBy("date")))
        return bootstrap.block_bootstrap_pairs(placed, ["temporada"], "__pos", pairs, replicates, k, seed=seed)

    parts = [drawn(days, seasonal)] if seasonal else []
    if overall:
        parts.append(drawn(days.withColumn("temporada", F.lit("all")), overall))
    samples = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return materialise(samples)


def pair_intervals(samples: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Percentile interval and number of valid replicates per season and pair."""
    keys = ["temporada", "pair"]
    counts = samples.groupBy(*keys).agg(F.count("gcc").alias("n"))
    return bootstrap.percentile_ci(samples, keys, alpha).join(counts, keys)


def drop_noisy(stationary: DataFrame, key: str) -> DataFrame:
    """Drop households in the top tenth of imputed share."""
    return drop_heavily_imputed(stationary, key)
