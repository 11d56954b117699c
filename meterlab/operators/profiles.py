"""The tables behind the exploratory plots: means, histograms, densities, boxes, trends.

Population-wide groups (a season, an hour of day, the whole table) can hold any
share of the rows, so these operators aggregate with map-side combine and take
quantiles from :mod:`meterlab.operators.order_stats`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlab.functions.calendar import season_of
from meterlab.functions.moments import mean_strict
from meterlab.operators.order_stats import exact_fences, exact_quantiles, null_safe_join, with_stats
from meterlab.operators.preparation import fences, outside
from meterlab.operators.stationary import numeric_columns


# --- grouped means -----------------------------------------------------------------

def mean_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None, strict: bool = True) -> DataFrame:
    """Mean of all (or the named) numeric columns per key."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=keys)
    return df.groupBy(*keys).agg(*[(mean_strict(c) if strict else F.avg(c)).alias(c) for c in cols])


def daily_max(df: DataFrame, ts: str, value: str, name: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("date")).agg(F.max(value).alias(name))


def daily_population(df: DataFrame, ts: str, cols: Sequence[str], max_of: str) -> DataFrame:
    """Daily strict means, the daily maximum of one column, season and cold/warm in one pass."""
    from meterlab.functions.calendar import temporada_of

    day = df.groupBy(F.to_date(ts).alias("date")).agg(
        *[mean_strict(c).alias(c) for c in cols], F.max(max_of).alias(f"max_{max_of}"))
    day = day.withColumn("season", season_of(F.col("date")))
    return day.withColumn("temporada", temporada_of(F.col("season")))


def households_per_day(df: DataFrame, ts: str, key: str) -> DataFrame:
    """Distinct households per day, exact; distinct pairs are formed map-side first."""
    pairs = df.select(F.to_date(ts).alias("date"), key).distinct()
    return pairs.groupBy("date").agg(F.count(key).alias("number_households"))


def mean_var_by(df: DataFrame, keys: Sequence[str], value: str, **variances: str) -> DataFrame:
    """Mean and variance of ``value`` per key, and variances of further columns, in one aggregate."""
    more = [F.var_samp(c).alias(name) for name, c in variances.items()]
    return df.groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.var_samp(value).alias("var_value"), *more)


def weekday_hour_profile(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean per weekday (Monday = 0) and hour; NULL-propagating."""
    return (df.groupBy(F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour"))
            .agg(mean_strict(value).alias(value)))


def week_axis_profile(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean per hour of the week on one 168-point axis that starts on a Monday."""
    # Fixed value: the Monday that anchors the drawn week.
    monday = F.lit("2024-05-06 00:00:00").cast("timestamp_ntz")
    means = df.groupBy(F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(F.avg(value).alias(value))
    at = F.timestamp_add("HOUR", F.col("weekday") * 24 + F.col("hour"), monday)
    return means.select(at.alias("axis_ts"), "weekday", "hour", value)


def block_variance_series(blocks: DataFrame) -> DataFrame:
    """Mean block variance per block start, with the season of the start."""
    means = blocks.groupBy("window_start").agg(F.avg("block_variance").alias("block_variance"))
    return means.withColumn("season", season_of(F.col("window_start")))


# --- outlier share, summaries ---------------------------------------------------------

def outlier_share(df: DataFrame, value: str) -> DataFrame:
    """Table-wide interquartile fences and percentage of all rows outside them."""
    stats = exact_quantiles(df, value, {"q1": .25, "q3": .75})
    rows = with_stats(df.select(value), stats, (), ["q1", "q3"])
    low, high = fences(F.col("q1"), F.col("q3"))
    share = F.avg(F.coalesce(outside(F.col(value), low, high), F.lit(False)).cast("double")) * 100
    return rows.agg(F.max(low).alias("lower_threshold"), F.max(high).alias("upper_threshold"), share.alias("percent"))


def six_number_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles, mean and maximum, and the number of NULLs."""
    by = list(by)
    basic = [F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"),
             F.sum(F.col(value).isNull().cast("bigint")).alias("n_null")]
    sums = df.groupBy(*by).agg(*basic) if by else df.agg(*basic)
    quart = exact_quantiles(df, value, {"q1": .25, "median": .5, "q3": .75}, by)
    if by:
        out = null_safe_join(sums, quart, by, "left")
    else:
        out = with_stats(sums, quart, (), ["q1", "median", "q3"])
    return out.select(*by, "min", "q1", "median", "mean", "q3", "max", "n_null")


def to_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), names: tuple[str, str] = ("variable", "value")) -> DataFrame:
    """Unpivot numeric columns to (variable, value) rows."""
    packed = F.array(*[F.struct(F.lit(c).alias(names[0]), F.col(c).cast("double").alias(names[1])) for c in cols])
    return df.select(*keep, F.inline(packed))


def summary_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sd, minimum, quartiles and maximum of every numeric column."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    long = to_long(df, cols)
    sums = long.groupBy("variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quart = exact_quantiles(long, "value", {"q1": .25, "median": .5, "q3": .75}, ["variable"])
    return null_safe_join(sums, quart, ["variable"], "left").select(
        "variable", "n", "mean", "sd", "min", "q1", "median", "q3", "max")


def category_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count and share of every level of every category column."""
    packed = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols])
    counts = df.select(F.inline(packed)).where(F.col("level").isNotNull()).groupBy("variable", "level").agg(
        F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("variable").agg(F.sum("n").alias("__t"))
    return null_safe_join(counts, totals, ["variable"]).select(
        "variable", "level", "n", F.try_divide(F.col("n"), F.col("__t")).alias("share"))


def frequency(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Frequency table with proportions of the whole."""
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("share", F.try_divide(F.col("n"), total))


def table_overview(df: DataFrame) -> DataFrame:
    """Rows, columns by kind, all-missing columns, complete rows, missing cells: one pass."""
    fields = df.schema.fields
    continuous = sum(isinstance(f.dataType, T.NumericType) for f in fields)
    present = {f.name: F.count(F.col(f.name)) for f in fields}
    complete = None
    for f in fields:
        ok = F.col(f.name).isNotNull()
        complete = ok if complete is None else complete & ok
    row = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(complete.cast("bigint")).alias("complete_rows"),
                 *[c.alias(f"__p{i}") for i, c in enumerate(present.values())])
    marks = [F.col(f"__p{i}") for i in range(len(fields))]
    all_missing = sum((F.when(m == 0, 1).otherwise(0) for m in marks), F.lit(0))
    cells = sum((F.col("n_rows") - m for m in marks), F.lit(0))
    return row.select(
        "n_rows", F.lit(len(fields)).cast("bigint").alias("n_columns"),
        F.lit(len(fields) - continuous).cast("bigint").alias("discrete_columns"),
        F.lit(continuous).cast("bigint").alias("continuous_columns"),
        all_missing.cast("bigint").alias("all_missing_columns"), "complete_rows",
        cells.cast("bigint").alias("missing_cells"))


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing values per column, one pass and one output row per column."""
    aggs = [F.struct(F.lit(c).alias("name"),
                     F.sum(F.col(c).isNull().cast("bigint")).alias("n_missing"),
                     F.avg(F.col(c).isNull().cast("double")).alias("pct_missing")) for c in df.columns]
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def category_by_flag(df: DataFrame, category: str, flag: str) -> DataFrame:
    """Category frequencies weighted by a boolean flag."""
    return df.groupBy(category).agg(F.sum(F.col(flag).cast("bigint")).alias("weight"))


# --- histogram, density, box ---------------------------------------------------------------

def in_range(df: DataFrame, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Keep values inside an axis range (removes rows before profiling)."""
    if low is not None:
        df = df.where(F.col(value) >= low)
    if high is not None:
        df = df.where(F.col(value) <= high)
    return df


def _counted(binned: DataFrame, by: list[str]) -> DataFrame:
    return binned.where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def _with_density(counts: DataFrame, by: list[str], width: Column) -> DataFrame:
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__t")) if by else counts.agg(F.sum("n").alias("__t"))
    joined = null_safe_join(counts, totals, by) if by else with_stats(counts, totals, (), ["__t"])
    return joined.withColumn("density", F.try_divide(F.col("n"), F.col("__t") * width)).drop("__t")


def histogram(df: DataFrame, value: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Fixed-width bins centred on multiples of ``width``, closed on the right."""
    by = list(by)
    place = F.ceil(F.col(value) / width - 0.5 - 1e-8)
    counts = _counted(df.select(*by, place.alias("bin")), by)
    return _with_density(counts, by, F.lit(width)).withColumn("center", F.col("bin") * width)


def histogram_bins(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """``bins`` equal bins over the table's range, the first centred on the minimum."""
    by = list(by)
    span = df.agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi")).select(
        "__lo", F.try_divide(F.col("__hi") - F.col("__lo"), F.lit(float(bins - 1))).alias("__w"))
    rows = with_stats(df.select(*by, value), span, (), ["__lo", "__w"])
    place = F.ceil(F.try_divide(F.col(value) - F.col("__lo"), F.nullif(F.col("__w"), F.lit(0.0))) - 0.5 - 1e-8)
    counts = _counted(rows.select(*by, F.when(F.col(value).isNotNull(), F.coalesce(place, F.lit(0))).alias("bin")), by)
    out = with_stats(counts, span, (), ["__lo", "__w"])
    out = _with_density(out, by, F.nullif(F.col("__w"), F.lit(0.0)))
    return out.withColumn("center", F.col("__lo") + F.col("bin") * F.col("__w")).drop("__lo", "__w")


def _spread(data: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Size, standard deviation and extremes per group, one pass over the rows."""
    aggs = [F.count(value).alias("n"), F.stddev_samp(value).alias("__sd"), F.max(F.abs(F.col(value))).alias("__abs"),
            F.min(value).alias("__min"), F.max(value).alias("__max")]
    return data.groupBy(*by).agg(*aggs) if by else data.agg(*aggs)


def _bandwidth_of(spread: DataFrame, data: DataFrame, value: str, by: list[str]) -> DataFrame:
    quart = exact_quantiles(data, value, {"__q1": .25, "__q3": .75}, by)
    full = null_safe_join(spread, quart, by) if by else with_stats(spread, quart, (), ["__q1", "__q3"])
    low = F.least(F.col("__sd"), (F.col("__q3") - F.col("__q1")) / 1.34)
    low = F.coalesce(F.nullif(low, F.lit(0.0)), F.nullif(F.col("__sd"), F.lit(0.0)),
                     F.nullif(F.col("__abs"), F.lit(0.0)), F.lit(1.0))
    return full.select(*by, "n", (0.9 * low * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))


def bandwidth(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rule-of-thumb bandwidth 0.9 min(sd, IQR/1.34) n^(-1/5) with its usual fallbacks."""
    by = list(by)
    return _bandwidth_of(_spread(df, value, by), df, value, by)


def kernel_density(df: DataFrame, value: str, by: Sequence[str] = (), points: int = 512,
                   reach: float = 8.0) -> DataFrame:
    """Gaussian kernel density per group on a common grid over the table's range.

    Rows are shared between their two neighbouring grid points in one aggregate
    with map-side combine, so the kernel sum runs over at most ``points``
    weighted points per group.  Kernel tails beyond ``reach`` bandwidths (below
    1e-14) are left out.
    """
    by = list(by)
    data = df.select(*by, F.col(value).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    spread = _spread(data, "__x", by)
    span = spread.agg(F.min("__min").alias("__lo"), F.max("__max").alias("__hi")).select(
        "__lo", F.nullif((F.col("__hi") - F.col("__lo")) / (points - 1), F.lit(0.0)).alias("__step"))
    rows = with_stats(data, span, (), ["__lo", "__step"])
    place = F.coalesce((F.col("__x") - F.col("__lo")) / F.col("__step"), F.lit(0.0))
    cell = F.least(F.floor(place), F.lit(points - 2).cast("bigint"))
    bins = (rows.withColumns({"__j": cell, "__f": place - cell}).groupBy(*by, "__j")
            .agg(F.count(F.lit(1)).alias("__n"), F.sum("__f").alias("__right")))
    halves = F.array(F.struct(F.col("__j").alias("j"), (F.col("__n") - F.col("__right")).alias("w")),
                     F.struct((F.col("__j") + 1).alias("j"), F.col("__right").alias("w")))
    mass = bins.select(*by, F.inline(halves)).groupBy(*by, "j").agg(F.sum("w").alias("w"))
    widths = _bandwidth_of(spread, data, "__x", by)
    mass = null_safe_join(mass, widths, by) if by else with_stats(mass, widths, (), ["n", "bw"])
    mass = with_stats(mass, span, (), ["__lo", "__step"])
    step = F.coalesce("__step", F.lit(1.0))
    radius = F.ceil(F.lit(reach) * F.col("bw") / step)
    targets = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("j") - radius),
                         F.least(F.lit(points - 1).cast("bigint"), F.col("j") + radius))
    reached = mass.withColumn("k", F.explode(targets))
    u = (F.col("k") - F.col("j")) * step / F.col("bw")
    bump = F.col("w") * F.exp(-0.5 * u * u) / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))
    return (reached.groupBy(*by, "k").agg(F.sum(bump).alias("density"), F.first(F.col("__lo") + F.col("k") * step).alias("x"))
            .select(*by, F.col("k").alias("point"), "x", "density"))


def box_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR) and outlier count per group."""
    return exact_fences(df, value, by)


# --- two variables ---------------------------------------------------------------------------

def local_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = (), span: float = 0.25, bins: int = 200,
                points: int = 80) -> DataFrame:
    """Local straight line of y on x on a grid of ``points`` over the range of x.

    Rows are reduced to sums per x-bin; the fit at a grid point uses tricube
    weights of the bin centres within ``span`` of the range.
    """
    by = list(by)
    data = df.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).dropna("any", subset=["__x", "__y"])
    box = data.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi")).select(
        "__lo", F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)).alias("__range"))
    rows = with_stats(data, box, (), ["__lo", "__range"])
    u = F.coalesce((F.col("__x") - F.col("__lo")) / F.col("__range"), F.lit(0.0))
    rows = rows.withColumn("u", u).withColumn("b", F.least(F.floor(F.col("u") * bins), F.lit(bins - 1).cast("bigint")))
    sums = rows.groupBy(*by, "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum("u").alias("su"), F.sum("__y").alias("sy"),
        F.sum(F.col("u") * F.col("u")).alias("suu"), F.sum(F.col("u") * F.col("__y")).alias("suy"))
    center = (F.col("b") + 0.5) / bins
    last = points - 1
    grid = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.ceil((center - span) * last)),
                      F.least(F.lit(last).cast("bigint"), F.floor((center + span) * last)))
    spread = sums.withColumn("g", F.explode(grid))
    r = F.abs(F.col("g") / float(last) - center) / span
    w = F.when(r < 1, F.pow(1 - F.pow(r, F.lit(3.0)), F.lit(3.0))).otherwise(0.0)
    fit = spread.withColumn("w", w).groupBy(*by, "g").agg(
        *[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n", "su", "sy", "suu", "suy")])
    mean_u, mean_y = F.try_divide(F.col("su"), F.col("n")), F.try_divide(F.col("sy"), F.col("n"))
    sxx = F.col("suu") - F.col("su") * mean_u
    sxy = F.col("suy") - F.col("su") * mean_y
    slope = F.when(sxx > 1e-9 * F.col("n"), F.try_divide(sxy, sxx)).otherwise(0.0)
    at = F.col("g") / float(last)
    fit = with_stats(fit.where(F.col("n") > 0), box, (), ["__lo", "__range"])
    return fit.select(*by, F.col("g").alias("point"),
                      (F.col("__lo") + at * F.coalesce("__range", F.lit(0.0))).alias("x"),
                      (mean_y + slope * (at - mean_u)).alias("fitted"), F.col("n").alias("weight"))


def scale_coefficient(df: DataFrame, a: str, b: str, rounded: bool = False) -> DataFrame:
    """max(a) / max(b), the factor that puts two series on one axis."""
    ratio = F.try_divide(F.max(a), F.nullif(F.max(b), F.lit(0.0)))
    return df.agg((F.round(ratio) if rounded else ratio).alias("coefficient"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlations of complete rows, all pairs in one aggregate; NULL for a constant column."""
    cols = list(cols)
    rows = df.select(*cols).dropna("any")
    upper = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    moments = rows.agg(*[
        (F.var_pop(cols[i]) if i == j else F.covar_pop(cols[i], cols[j])).alias(f"__m{i}_{j}") for i, j in upper])

    def rho(i: int, j: int) -> Column:
        spread = F.sqrt(F.col(f"__m{i}_{i}")) * F.sqrt(F.col(f"__m{j}_{j}"))
        return F.try_divide(F.col(f"__m{min(i, j)}_{max(i, j)}"), F.nullif(spread, F.lit(0.0)))

    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rho(i, j).alias("rho"))
                      for i, a in enumerate(cols) for j, b in enumerate(cols)])
    return moments.select(F.inline(pairs))


def display_sample(df: DataFrame, rows: int, keys: Sequence[str], seed: int = 7) -> DataFrame:
    """Exactly ``rows`` rows (or all, if fewer) with the least hashes of ``keys`` and ``seed``, ties by the keys.

    The same rows in every run and for any partitioning; partitions keep their own ``rows`` least, so nothing is sorted
    as a whole.  Samples of parts of a table merge to the sample of the table.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return df.withColumn("__lot", F.md5(name)).orderBy("__lot", *keys).limit(rows).drop("__lot")


def variable_pairs(df: DataFrame, anchor: str, cols: Sequence[str], keep: Sequence[str] = (),
                   fraction: float | None = None, seed: int = 1) -> DataFrame:
    """All variables against one anchor, long form; optionally a display sample of rows."""
    rows = df if fraction is None else df.sample(fraction=fraction, seed=seed)
    return to_long(rows, [c for c in cols if c != anchor], [*keep, anchor])


def pca(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """Principal components of standardised complete rows: explained share and loadings.

    The fit is distributed; the result has ``k * len(cols)`` rows.  Signs are fixed: of the loadings of at least half
    the largest size, the first in the order of ``cols`` is positive.
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=list(cols), outputCol="raw").transform(df.select(*cols).dropna("any"))
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="scaled", outputCol="pc").fit(scaled)
    share, load = model.explainedVariance.toArray(), model.pc.toArray()
    large = abs(load) >= abs(load).max(axis=0) / 2
    load = load * [-1.0 if load[large[:, j], j][0] < 0 else 1.0 for j in range(k)]
    table = [(j + 1, float(share[j]), c, float(load[i, j])) for j in range(k) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(table, "component int, explained double, variable string, loading double")


# --- typical hour, mode ---------------------------------------------------------------------

def mode_by(df: DataFrame, keys: Sequence[str], col: str, ts: str, name: str | None = None) -> DataFrame:
    """Most frequent value per group; ties go to the value that appears first in time."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(
        F.count(F.lit(1)).alias("__n"), F.min(ts).alias("__first"))
    first = counts.groupBy(*keys).agg(F.max("__n").alias("__n"))
    top = null_safe_join(counts, first, [*keys, "__n"])
    return top.groupBy(*keys).agg(F.min_by(F.col(col), F.struct("__first", F.col(col))).alias(name or col))


def typical_hour(df: DataFrame, key: str, ts: str, value: str, attributes: Sequence[str], is_home: str) -> DataFrame:
    """Median value at home per (household, hour) with the modal household attributes."""
    rows = df.where(F.col(is_home)).withColumn("hour", F.hour(ts))
    out = rows.groupBy(key, "hour").agg(F.median(value).alias(value))
    for a in attributes:
        out = null_safe_join(out, mode_by(rows, [key, "hour"], a, ts), [key, "hour"], "left")
    return out
