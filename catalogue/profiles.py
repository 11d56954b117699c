"""Tables behind the exploratory plots."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalogue import tables as t
from catalogue.preparation import BLOCKS, REGION_BLOCKS
from catalogue.registry import query
from meterlab.functions.calendar import season_levels, season_of
from meterlab.operators import activity, profiles as pf
from meterlab.operators.order_stats import exact_quantiles

CONTINUOUS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _home(spark, d):
    return activity.detect_home(t.hourly(spark, d), "meter", "ts", "energy")


def _region_season(spark, d):
    return t.sales(spark, d, "r_name").withColumn("season", season_of(F.col("ts")))


SEASONED = t.SALES_REGION + f""",
seasoned AS (SELECT *, {t.season_sql()} AS season FROM sales)"""


@query("daily_mean_all_numeric", "date", "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax", sql="""
SELECT CAST(l_shipdate AS DATE) AS date, avg(l_orderkey) AS l_orderkey, avg(l_partkey) AS l_partkey,
       avg(l_suppkey) AS l_suppkey, avg(l_linenumber) AS l_linenumber, avg(l_quantity) AS l_quantity,
       avg(l_extendedprice) AS l_extendedprice, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax
FROM lineitem GROUP BY 1""")
def daily_mean_all_numeric(spark, d):
    return pf.mean_by(t.table(spark, d, "lineitem").withColumn("date", F.to_date("l_shipdate")), ["date"])


@query("hourly_mean_strict", "ts", "energy temperature", sql=f"""
WITH {t.HOURLY_WEATHER}
SELECT ts, avg(energy) AS energy, CASE WHEN count(temperature) = count(*) THEN avg(temperature) END AS temperature
FROM hourly_weather GROUP BY ts""")
def hourly_mean_strict(spark, d):
    return pf.mean_by(t.hourly_weather(spark, d), ["ts"])


@query("hourly_mean_by_group", "ts acorn_grouped", "energy", sql=f"""
WITH {t.USER_HOURLY},
{t.HOUSEHOLDS}
SELECT ts, acorn_grouped, avg(energy) AS energy FROM user_hourly LEFT JOIN households ON meter = id GROUP BY 1, 2""")
def hourly_mean_by_group(spark, d):
    hh = t.households(spark, d).select(F.col("id").alias("meter"), "acorn_grouped")
    return pf.mean_by(t.user_hourly(spark, d).join(hh, "meter", "left"), ["ts", "acorn_grouped"], ["energy"])


@query("daily_mean_by_household", "date meter", "energy", sql=f"""
WITH {t.USER_HOURLY}
SELECT CAST(ts AS DATE) AS date, meter, avg(energy) AS energy FROM user_hourly GROUP BY 1, 2""")
def daily_mean_by_household(spark, d):
    return pf.mean_by(t.user_hourly(spark, d).withColumn("date", F.to_date("ts")), ["date", "meter"], ["energy"])


@query("hour_mean_by_home", "hour is_home category", "energy", sql=f"""
WITH {BLOCKS}
SELECT hour(ts) AS hour, is_home, CASE WHEN is_home THEN 'at home' WHEN NOT is_home THEN 'away' END AS category,
       avg(energy) AS energy
FROM home GROUP BY 1, 2""")
def hour_mean_by_home(spark, d):
    out = pf.mean_by(_home(spark, d).withColumn("hour", F.hour("ts")), ["hour", "is_home"], ["energy"])
    return out.withColumn("category", F.when(F.col("is_home"), "at home").when(~F.col("is_home"), "away"))


@query("daily_max", "date", "max_energy", sql=f"""
WITH {t.USER_HOURLY}
SELECT CAST(ts AS DATE) AS date, max(energy) AS max_energy FROM user_hourly GROUP BY 1""")
def daily_max(spark, d):
    return pf.daily_max(t.user_hourly(spark, d), "ts", "energy", "max_energy")


@query("daily_population", "date season temporada", "energy temperature max_temperature", sql=f"""
WITH {t.SALES_HOURLY},
days AS (
  SELECT CAST(ts AS DATE) AS date, avg(energy) AS energy, avg(temperature) AS temperature,
         max(temperature) AS max_temperature FROM sales_hourly GROUP BY 1),
tagged AS (SELECT *, {t.season_sql('date')} AS season FROM days)
SELECT *, {t.TEMPORADA} AS temporada FROM tagged""")
def daily_population(spark, d):
    return pf.daily_population(t.sales_hourly(spark, d), "ts", ["energy", "temperature"], "temperature")


@query("households_per_day", "date number_households", sql=f"""
WITH {t.USER_HOURLY}
SELECT CAST(ts AS DATE) AS date, count(DISTINCT meter) AS number_households FROM user_hourly GROUP BY 1""")
def households_per_day(spark, d):
    return pf.households_per_day(t.readings(spark, d), "ts", "meter")


@query("mean_var_by_ts", "ts", "mean_value var_value var_standardised", sql=f"""
WITH {t.HOURLY},
z AS (SELECT *, (energy - avg(energy) OVER w) / nullif(stddev_samp(energy) OVER w, 0) AS z
      FROM hourly WINDOW w AS (PARTITION BY meter))
SELECT ts, avg(energy) AS mean_value, var_samp(energy) AS var_value, var_samp(z) AS var_standardised
FROM z GROUP BY ts""")
def mean_var_by_ts(spark, d):
    z = activity.zscore(t.hourly(spark, d), "energy", ["meter"], "z")
    return pf.mean_var_by(z, ["ts"], "energy", var_standardised="z")


@query("weekday_hour_profile", "weekday hour", "energy", sql=f"""
WITH {t.USER_HOURLY}
SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, avg(energy) AS energy FROM user_hourly GROUP BY 1, 2""")
def weekday_hour_profile(spark, d):
    return pf.weekday_hour_profile(t.user_hourly(spark, d), "ts", "energy")


@query("week_axis_profile", "axis_ts weekday hour", "energy", sql=f"""
WITH {t.USER_HOURLY}
SELECT TIMESTAMP '2024-05-06 00:00:00' + to_hours(CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER)) AS axis_ts,
       isodow(ts) - 1 AS weekday, hour(ts) AS hour, avg(energy) AS energy FROM user_hourly GROUP BY 1, 2, 3""")
def week_axis_profile(spark, d):
    return pf.week_axis_profile(t.user_hourly(spark, d), "ts", "energy")


@query("block_variance_series", "window_start season", "block_variance", sql=f"""
WITH {REGION_BLOCKS}
SELECT window_start, {t.season_sql('window_start')} AS season, avg(block_variance) AS block_variance
FROM blocks GROUP BY 1, 2""")
def block_variance_series(spark, d):
    return pf.block_variance_series(activity.block_variance(t.sales_hourly(spark, d, "r_name"), "meter", "ts", "energy"))


@query("season_p10", "season", "p10", sql=f"""
WITH {REGION_BLOCKS}
SELECT season, quantile_cont(block_variance, 0.1) AS p10 FROM blocks WHERE block_variance IS NOT NULL GROUP BY season""")
def season_p10(spark, d):
    blocks = activity.block_variance(t.sales_hourly(spark, d, "r_name"), "meter", "ts", "energy")
    return exact_quantiles(blocks, "block_variance", {"p10": .1}, ["season"])


@query("global_outlier_share", "one", "lower_threshold upper_threshold percent", sql="""
SELECT 1 AS one, any_value(lo) AS lower_threshold, any_value(hi) AS upper_threshold,
       100 * avg(CASE WHEN value < lo OR value > hi THEN 1.0 ELSE 0.0 END) AS percent
FROM events, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))""")
def global_outlier_share(spark, d):
    return pf.outlier_share(t.table(spark, d, "events"), "value").withColumn("one", F.lit(1))


@query("six_number_summary", "n_null", "min q1 median mean q3 max", sql="""
SELECT CAST(count(*) - count(value) AS BIGINT) AS n_null, min(value) AS min, quantile_cont(value, 0.25) AS q1,
       quantile_cont(value, 0.5) AS median, avg(value) AS mean, quantile_cont(value, 0.75) AS q3, max(value) AS max
FROM events""")
def six_number_summary(spark, d):
    return pf.six_number_summary(t.table(spark, d, "events"), "value")


@query("summary_table", "variable n", "mean sd min q1 median q3 max", sql="""
SELECT variable, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min,
       quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3,
       max(value) AS max
FROM (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
      ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME variable VALUE value)
GROUP BY variable""")
def summary_table(spark, d):
    return pf.summary_table(t.table(spark, d, "lineitem"), CONTINUOUS)


@query("category_shares", "variable level n", "share", sql="""
WITH c AS (
  SELECT 'l_returnflag' AS variable, l_returnflag AS level FROM lineitem
  UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem)
SELECT variable, level, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY variable) AS share
FROM c WHERE level IS NOT NULL GROUP BY 1, 2""")
def category_shares(spark, d):
    return pf.category_shares(t.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("frequency", "c_mktsegment n", "share", sql="""
SELECT c_mktsegment, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM customer GROUP BY 1""")
def frequency(spark, d):
    return pf.frequency(t.table(spark, d, "customer"), ["c_mktsegment"])


OVERVIEW = f"""
WITH {t.HOURLY_WEATHER}"""


@query("table_overview", "n_rows n_columns discrete_columns continuous_columns all_missing_columns complete_rows missing_cells", sql=f"""
{OVERVIEW}
SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_columns, CAST(2 AS BIGINT) AS discrete_columns,
       CAST(2 AS BIGINT) AS continuous_columns, CAST(0 AS BIGINT) AS all_missing_columns,
       count(temperature) AS complete_rows, count(*) - count(temperature) AS missing_cells
FROM hourly_weather""")
def table_overview(spark, d):
    return pf.table_overview(t.hourly_weather(spark, d))


@query("missing_profile", "name n_missing", "pct_missing", sql=f"""
{OVERVIEW}
SELECT 'meter' AS name, count(*) - count(meter) AS n_missing, 1 - count(meter) / count(*) AS pct_missing FROM hourly_weather
UNION ALL SELECT 'ts', count(*) - count(ts), 1 - count(ts) / count(*) FROM hourly_weather
UNION ALL SELECT 'energy', count(*) - count(energy), 1 - count(energy) / count(*) FROM hourly_weather
UNION ALL SELECT 'temperature', count(*) - count(temperature), 1 - count(temperature) / count(*) FROM hourly_weather""")
def missing_profile(spark, d):
    return pf.missing_profile(t.hourly_weather(spark, d))


@query("category_by_home", "season weight", sql=f"""
WITH {REGION_BLOCKS}
SELECT season, CAST(sum(CASE WHEN is_home THEN 1 WHEN NOT is_home THEN 0 END) AS BIGINT) AS weight
FROM home GROUP BY season""")
def category_by_home(spark, d):
    home = activity.detect_home(t.sales_hourly(spark, d, "r_name"), "meter", "ts", "energy")
    return pf.category_by_flag(home, "season", "is_home")


@query("histogram", "bin n", "center density", sql="""
WITH b AS (SELECT CAST(ceil(value / 5.0 - 0.5 - 1e-8) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1)
SELECT bin, n, bin * 5.0 AS center, n / (sum(n) OVER () * 5.0) AS density FROM b""")
def histogram(spark, d):
    return pf.histogram(t.table(spark, d, "events"), "value", 5.0)


@query("histogram_by_group", "event_type bin n", "center density", sql="""
WITH b AS (
  SELECT event_type, CAST(ceil(value / 5.0 - 0.5 - 1e-8) AS BIGINT) AS bin, count(*) AS n
  FROM events WHERE value BETWEEN 0 AND 120 GROUP BY 1, 2)
SELECT event_type, bin, n, bin * 5.0 AS center, n / (sum(n) OVER (PARTITION BY event_type) * 5.0) AS density FROM b""")
def histogram_by_group(spark, d):
    return pf.histogram(pf.in_range(t.table(spark, d, "events"), "value", 0, 120), "value", 5.0, ["event_type"])


@query("histogram_bins", "bin n", "center density", sql=f"""
WITH {t.USER_HOURLY},
s AS (SELECT min(energy) AS lo, (max(energy) - min(energy)) / 29.0 AS w FROM user_hourly),
b AS (SELECT CAST(ceil((energy - lo) / w - 0.5 - 1e-8) AS BIGINT) AS bin, count(*) AS n FROM user_hourly, s GROUP BY 1)
SELECT bin, n, lo + bin * w AS center, n / (sum(n) OVER () * w) AS density FROM b, s""")
def histogram_bins(spark, d):
    return pf.histogram_bins(t.user_hourly(spark, d), "energy", 30)


def density_sql(src: str, value: str, by: str, points: int = 512, prefix: str = "") -> str:
    """Kernel density by linear sharing to the grid, as CTEs ending in ``density``."""
    return f"""span AS (SELECT min({value}) AS lo, (max({value}) - min({value})) / {points - 1}.0 AS step FROM {src}),
stat AS (
  SELECT {by}, count(*) AS n, 0.9 * pow(count(*), -0.2) * coalesce(
           nullif(least(stddev_samp({value}), (quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)) / 1.34), 0),
           nullif(stddev_samp({value}), 0), nullif(max(abs({value})), 0), 1) AS bw
  FROM {src} WHERE {value} IS NOT NULL GROUP BY {by}),
place AS (
  SELECT {by}, ({value} - lo) / step AS p,
         least(CAST(floor(({value} - lo) / step) AS BIGINT), {points - 2}) AS j FROM {src}, span WHERE {value} IS NOT NULL),
mass AS (
  SELECT {by}, j, sum(w) AS w FROM (
    SELECT {by}, j, 1 - (p - j) AS w FROM place UNION ALL SELECT {by}, j + 1, p - j FROM place) GROUP BY {by}, j),
density AS (
  SELECT {by}, k AS point, any_value(lo + k * step) AS x,
         sum(w * exp(-0.5 * pow((k - j) * step / bw, 2)) / (n * bw * {math.sqrt(2 * math.pi)!r})) AS density
  FROM mass JOIN stat USING ({by}), span, (SELECT unnest(range({points})) AS k)
  WHERE abs(k - j) <= ceil(8.0 * bw / step) GROUP BY {by}, k)"""


@query("kernel_density", "season point", "x density", sql=f"""
WITH {SEASONED},
{density_sql('seasoned', 'energy', 'season')}
SELECT * FROM density""")
def kernel_density(spark, d):
    return pf.kernel_density(_region_season(spark, d), "energy", ["season"])


@query("kernel_density_weekend", "weekend point", "x density", sql=f"""
WITH src AS (SELECT CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Working Days' END AS weekend, value FROM events),
{density_sql('src', 'value', 'weekend', 128)}
SELECT * FROM density""")
def kernel_density_weekend(spark, d):
    ev = t.table(spark, d, "events").withColumn(
        "weekend", F.when(F.weekday("ts") >= 5, "Weekend").otherwise("Working Days"))
    return pf.kernel_density(ev, "value", ["weekend"], points=128)


def box_sql(src: str, value: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       min(CASE WHEN {value} >= q1 - 1.5 * (q3 - q1) THEN {value} END) AS lower_whisker,
       max(CASE WHEN {value} <= q3 + 1.5 * (q3 - q1) THEN {value} END) AS upper_whisker,
       count(CASE WHEN {value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
FROM {src} JOIN (
  SELECT {by}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
         quantile_cont({value}, 0.75) AS q3 FROM {src} WHERE {value} IS NOT NULL GROUP BY {by}) USING ({by})
WHERE {value} IS NOT NULL GROUP BY {by}"""


@query("box_stats", "season n n_outliers", "q1 median q3 lower_whisker upper_whisker", sql=f"""
WITH {SEASONED}
{box_sql('seasoned', 'energy', 'season')}""")
def box_stats(spark, d):
    return pf.box_stats(_region_season(spark, d), "energy", ["season"])


@query("box_stats_by_hour", "hour n n_outliers", "q1 median q3 lower_whisker upper_whisker", sql=f"""
WITH src AS (SELECT hour(ts) AS hour, value FROM events)
{box_sql('src', 'value', 'hour')}""")
def box_stats_by_hour(spark, d):
    return pf.box_stats(t.table(spark, d, "events").withColumn("hour", F.hour("ts")), "value", ["hour"])


def trend_sql(src: str, x: str, y: str, by: str, span: float = 0.25, bins: int = 200, points: int = 80) -> str:
    last = points - 1
    return f"""span AS (SELECT min({x}) AS lo, max({x}) - min({x}) AS rng FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
sums AS (
  SELECT {by}, least(CAST(floor(u * {bins}) AS BIGINT), {bins - 1}) AS b, count(*) AS n, sum(u) AS su, sum(y) AS sy,
         sum(u * u) AS suu, sum(u * y) AS suy
  FROM (SELECT {by}, ({x} - lo) / rng AS u, {y} AS y FROM {src}, span WHERE {x} IS NOT NULL AND {y} IS NOT NULL)
  GROUP BY 1, 2),
weighted AS (
  SELECT *, CASE WHEN r < 1 THEN pow(1 - pow(r, 3), 3) ELSE 0 END AS w FROM (
    SELECT sums.*, g, abs(g / {last}.0 - (b + 0.5) / {bins}.0) / {span} AS r
    FROM sums, (SELECT unnest(range({points})) AS g)) WHERE r <= 1),
fit AS (
  SELECT {by}, g, sum(w * n) AS n, sum(w * su) AS su, sum(w * sy) AS sy, sum(w * suu) AS suu, sum(w * suy) AS suy
  FROM weighted GROUP BY {by}, g),
trend AS (
  SELECT {by}, g AS point, lo + g / {last}.0 * rng AS x, n AS weight,
         sy / n + CASE WHEN suu - su * su / n > 1e-9 * n
           THEN (suy - sy * su / n) / (suu - su * su / n) * (g / {last}.0 - su / n) ELSE 0 END AS fitted
  FROM fit, span WHERE n > 0)"""


@query("local_trend", "meter point", "x fitted weight", sql=f"""
WITH {t.SALES_DAILY},
thousands AS (SELECT meter, temperature, energy / 1000 AS energy FROM sales_daily),
{trend_sql('thousands', 'temperature', 'energy', 'meter')}
SELECT * FROM trend""")
def local_trend(spark, d):
    rows = t.sales_daily(spark, d).withColumn("energy", F.col("energy") / 1000)
    return pf.local_trend(rows, "temperature", "energy", ["meter"])


@query("scale_coefficient", "one", "coefficient rounded", sql=f"""
WITH {t.HOURLY_WEATHER}
SELECT 1 AS one, max(temperature) / max(energy) AS coefficient, round(max(temperature) / max(energy)) AS rounded
FROM hourly_weather""")
def scale_coefficient(spark, d):
    exact = pf.scale_coefficient(t.hourly_weather(spark, d), "temperature", "energy")
    return exact.withColumn("rounded", F.round("coefficient")).withColumn("one", F.lit(1))


@query("correlation_matrix", "a b", "rho", sql=" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM lineitem" for a in CONTINUOUS for b in CONTINUOUS))
def correlation_matrix(spark, d):
    return pf.correlation_matrix(t.table(spark, d, "lineitem"), CONTINUOUS)


@query("variable_pairs", "l_orderkey l_linenumber variable", "l_quantity value", sql="""
SELECT l_orderkey, l_linenumber, l_quantity, variable, value FROM (
  UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
  ON l_extendedprice, l_discount, l_tax INTO NAME variable VALUE value)""")
def variable_pairs(spark, d):
    return pf.variable_pairs(t.table(spark, d, "lineitem"), "l_quantity", CONTINUOUS, ["l_orderkey", "l_linenumber"])


@query("display_sample", "l_orderkey l_linenumber", "l_quantity l_extendedprice", sql="""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
ORDER BY md5(l_orderkey || ':' || l_linenumber || ':7'), l_orderkey, l_linenumber LIMIT 500""")
def display_sample(spark, d):
    return pf.display_sample(t.table(spark, d, "lineitem"), 500, ["l_orderkey", "l_linenumber"])


@query("season_profile_ordered", "season place n", "energy", sql=f"""
WITH {t.SALES_HOURLY},
levels AS (SELECT * FROM (VALUES ('Winter', 1), ('Spring', 2), ('Summer', 3), ('Autumn', 4)) AS v(season, place)),
seasoned AS (SELECT *, {t.season_sql()} AS season FROM sales_hourly)
SELECT season, CAST(place AS BIGINT) AS place, count(energy) AS n, avg(energy) AS energy FROM levels LEFT JOIN seasoned USING (season) GROUP BY ALL""")
def season_profile_ordered(spark, d):
    """All seasons in the order of the year, also those without rows."""
    rows = t.sales_hourly(spark, d).groupBy(season_of(F.col("ts")).alias("season")).agg(F.count("energy").alias("n"), F.avg("energy").alias("energy"))
    return season_levels(spark).join(rows, "season", "left").fillna(0, ["n"]).orderBy("place")


def pca_sql(src: str, cols: list[str], k: int) -> str:
    """Leading eigenvectors of the correlation matrix: squared often, a matrix becomes the projection on its first
    eigenvector; what that explains is taken off, and the rest is squared again."""
    cells = [f"SELECT {i} AS i, {j} AS j, corr({a}, {b}) AS v FROM complete" for i, a in enumerate(cols) for j, b in enumerate(cols)]
    parts = [f"complete AS (SELECT * FROM {src} WHERE {' AND '.join(c + ' IS NOT NULL' for c in cols)})",
             "a1 AS (" + " UNION ALL ".join(cells) + ")"]
    for c in range(1, k + 1):
        parts.append(f"""p{c} AS (
  SELECT 0 AS step, i, j, v FROM a{c}
  UNION ALL
  SELECT step, i, j, v / sqrt(sum(v * v) OVER ()) AS v FROM (
    SELECT x.step + 1 AS step, x.i, y.j, sum(x.v * y.v) AS v FROM p{c} x JOIN p{c} y ON x.j = y.i WHERE x.step < 48 GROUP BY ALL)),
f{c} AS (SELECT i, j, v FROM p{c} WHERE step = 48),
raw{c} AS (SELECT i, v / sqrt((SELECT max(v) FROM f{c} WHERE i = j)) AS v FROM f{c}
           WHERE j = (SELECT arg_max(i, v) FROM f{c} WHERE i = j)),
sign{c} AS (SELECT arg_min(sign(v), i) AS s FROM raw{c} WHERE abs(v) >= (SELECT max(abs(v)) FROM raw{c}) / 2),
u{c} AS (SELECT i, v * s AS v FROM raw{c}, sign{c}),
l{c} AS (SELECT sum(x.v * m.v * y.v) AS root FROM a{c} m JOIN u{c} x ON m.i = x.i JOIN u{c} y ON m.j = y.i),
a{c + 1} AS (SELECT m.i, m.j, m.v - root * x.v * y.v AS v FROM a{c} m JOIN u{c} x ON m.i = x.i JOIN u{c} y ON m.j = y.i, l{c})""")
    names = "[" + ", ".join(f"'{c}'" for c in cols) + "]"
    rows = [f"SELECT CAST({c} AS BIGINT) AS component, {names}[i + 1] AS variable, root / {len(cols)} AS explained, v AS loading FROM u{c}, l{c}"
            for c in range(1, k + 1)]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + " UNION ALL ".join(rows)


@query("pca", "component variable", "explained loading", sql=pca_sql("lineitem", CONTINUOUS, 3))
def pca(spark, d):
    return pf.pca(t.table(spark, d, "lineitem"), CONTINUOUS, 3)


@query("typical_hour", "meter hour acorn_grouped tariff", "energy", sql=f"""
WITH {t.HOUSEHOLDS},
user_hourly AS (
  SELECT user_id AS meter, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, avg(value) AS energy
  FROM events GROUP BY 1, 2)
SELECT meter, hour(ts) AS hour, median(energy) AS energy, mode(acorn_grouped) AS acorn_grouped, mode(tariff) AS tariff
FROM user_hourly JOIN households ON meter = id GROUP BY 1, 2""")
def typical_hour(spark, d):
    hh = t.households(spark, d).withColumnRenamed("id", "meter")
    rows = t.user_hourly(spark, d).join(hh, "meter").withColumn("is_home", F.lit(True))
    return pf.typical_hour(rows, "meter", "ts", "energy", ["acorn_grouped", "tariff"], "is_home")


@query("mode_first_seen", "meter hour event_type", sql="""
WITH c AS (
  SELECT user_id AS meter, hour(ts) AS hour, event_type, count(*) AS n, min(ts) AS first FROM events GROUP BY 1, 2, 3)
SELECT meter, hour, event_type FROM c QUALIFY row_number() OVER (PARTITION BY meter, hour ORDER BY n DESC, first) = 1""")
def mode_first_seen(spark, d):
    ev = t.table(spark, d, "events").select(F.col("user_id").alias("meter"), F.hour("ts").alias("hour"), "event_type", "ts")
    return pf.mode_by(ev, ["meter", "hour"], "event_type", "ts")
