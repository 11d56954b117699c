"""Sources, cleaning, activity at home."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import tables as t
from catalogue.registry import query
from meterlab.functions.calendar import add_calendar, season_of, temporada_of
from meterlab.operators import activity, preparation as prep
from meterlab.plans.cleaning import clean_readings, enrich_hourly
from meterlab.sources.readers import incomplete_rows

CALENDAR = """slots AS (
  SELECT meter, unnest(generate_series(min(ts), max(ts), INTERVAL 1 {step})) AS ts FROM {src} GROUP BY meter),
gaps AS (
  SELECT meter, ts FROM slots ANTI JOIN (SELECT DISTINCT meter, ts FROM {src}) AS seen USING (meter, ts))"""
DAY_ROWS = t.DAY_SLOTS + ",\nrows_ AS (SELECT DISTINCT meter, ts, energy FROM day_slots)"
DAY_GAPS = DAY_ROWS + ",\n" + CALENDAR.format(step="DAY", src="rows_")
DAY_FILLED = DAY_GAPS + """,
filled AS (SELECT meter, ts, energy FROM rows_ UNION ALL SELECT meter, ts, NULL FROM gaps)"""


def _day_rows(spark, d):
    return prep.distinct_complete(t.day_slots(spark, d))


@query("readings_clean", "meter ts", "energy", sql=f"WITH {DAY_ROWS} SELECT * FROM rows_")
def readings_clean(spark, d):
    return _day_rows(spark, d)


@query("missing_slots", "meter ts", sql=f"WITH {DAY_GAPS} SELECT * FROM gaps")
def missing_slots(spark, d):
    return prep.missing_slots(_day_rows(spark, d), "meter", "ts", "1 DAY")


@query("missing_slots_exempt", "meter ts",
       sql=f"WITH {DAY_GAPS} SELECT * FROM gaps WHERE isodow(ts) <> 7")
def missing_slots_exempt(spark, d):
    rows = _day_rows(spark, d)
    first_last = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = first_last.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("ts"))
    return prep.missing_slots(rows, "meter", "ts", "1 DAY", exempt=days.where(F.weekday("ts") == 6))


@query("missing_slot_summary", "meter min_ts max_ts n_missing", sql=f"""
WITH {DAY_GAPS}
SELECT meter, min_ts, max_ts, coalesce(n, 0) AS n_missing
FROM (SELECT meter, min(ts) AS min_ts, max(ts) AS max_ts FROM rows_ GROUP BY meter)
LEFT JOIN (SELECT meter, count(*) AS n FROM gaps GROUP BY meter) USING (meter)""")
def missing_slot_summary(spark, d):
    return prep.missing_slot_summary(_day_rows(spark, d), "meter", "ts", "1 DAY")


@query("gap_filled", "meter ts", "energy", sql=f"WITH {DAY_FILLED} SELECT * FROM filled")
def gap_filled(spark, d):
    return prep.gap_fill(_day_rows(spark, d), "meter", "ts", "1 DAY")


@query("null_rate", "meter", "pct_na", sql=f"""
WITH {DAY_FILLED}
SELECT meter, avg(CASE WHEN energy IS NULL THEN 1.0 ELSE 0.0 END) AS pct_na FROM filled GROUP BY meter""")
def null_rate(spark, d):
    return prep.null_rate(gap_filled(spark, d), "meter", "energy")


@query("removed_sparse", "meter ts", "energy", sql=f"""
WITH {DAY_FILLED}
SELECT meter, ts, energy FROM filled WHERE meter NOT IN (
  SELECT meter FROM filled GROUP BY meter HAVING avg(CASE WHEN energy IS NULL THEN 1.0 ELSE 0.0 END) > 0.1)""")
def removed_sparse(spark, d):
    return prep.drop_sparse(gap_filled(spark, d), "meter", "energy", 0.1)


HOUR_FILLED = t.HOUR_SLOTS + ",\n" + CALENDAR.format(step="HOUR", src="hour_slots") + """,
filled AS (SELECT meter, ts, energy FROM hour_slots UNION ALL SELECT meter, ts, NULL FROM gaps)"""
IMPUTE = """stage AS (
  SELECT meter, ts, energy AS raw, coalesce(energy, avg(energy) OVER (PARTITION BY meter, hour(ts))) AS energy
  FROM filled),
imputed AS (SELECT meter, ts, coalesce(energy, avg(energy) OVER (PARTITION BY meter)) AS energy FROM stage)"""


@query("imputed_hour_mean", "meter ts", "energy", sql=f"WITH {HOUR_FILLED},\n{IMPUTE} SELECT * FROM imputed")
def imputed_hour_mean(spark, d):
    filled = prep.gap_fill(t.hour_slots(spark, d), "meter", "ts", "1 HOUR")
    return prep.impute_hour_mean(filled, "meter", "ts", "energy")


@query("hourly_mean", "meter ts", "energy", sql=f"WITH {t.USER_HOURLY} SELECT * FROM user_hourly")
def hourly_mean(spark, d):
    return t.user_hourly(spark, d)


OUTLIERS = """fenced AS (
  SELECT *, quantile_cont(energy, 0.25) OVER (PARTITION BY meter) AS q1,
         quantile_cont(energy, 0.75) OVER (PARTITION BY meter) AS q3 FROM {src}),
rates AS (
  SELECT meter, avg(CASE WHEN energy < q1 - 1.5 * (q3 - q1) OR energy > q3 + 1.5 * (q3 - q1)
                         THEN 1.0 ELSE 0.0 END) AS pct_outliers
  FROM fenced GROUP BY meter)"""


@query("outlier_rate", "meter", "pct_outliers", sql=f"""
WITH {t.USER_HOURLY},
{OUTLIERS.format(src='user_hourly')}
SELECT * FROM rates""")
def outlier_rate(spark, d):
    return prep.outlier_rate(t.user_hourly(spark, d), "meter", "energy")


@query("removed_outlier_heavy", "meter ts", "energy", sql=f"""
WITH {t.USER_HOURLY},
{OUTLIERS.format(src='user_hourly')}
SELECT * FROM user_hourly WHERE meter NOT IN (SELECT meter FROM rates WHERE pct_outliers > 0.1)""")
def removed_outlier_heavy(spark, d):
    return prep.drop_outlier_heavy(t.user_hourly(spark, d), "meter", "energy")


CHAIN = """,
na AS (
  SELECT meter FROM filled GROUP BY meter HAVING avg(CASE WHEN energy IS NULL THEN 1.0 ELSE 0.0 END) > 0.1),
""" + IMPUTE + """,
averaged AS (
  SELECT meter, {unit} AS ts, avg(energy) AS energy FROM imputed WHERE meter NOT IN (SELECT meter FROM na) GROUP BY ALL),
""" + OUTLIERS.replace("{src}", "averaged") + """,
noisy AS (SELECT meter FROM rates WHERE pct_outliers > 0.1),
removed AS (
  SELECT meter AS id_removed, {block} AS block, 'NA excess' AS motive FROM na
  UNION ALL SELECT meter, {block}, 'Outlier Excess' FROM noisy),
clean AS (SELECT * FROM averaged WHERE meter NOT IN (SELECT meter FROM noisy))"""
CLEAN = DAY_FILLED + CHAIN.format(unit="ts", block="'block_' || (meter % 10)")
HALF_FILLED = t.HALF_HOURS + """,
rows_ AS (SELECT DISTINCT meter, ts, energy FROM half_hours),
""" + CALENDAR.format(step="HOUR", src="rows_").replace("INTERVAL 1 HOUR", "INTERVAL 30 MINUTE") + """,
filled AS (SELECT meter, ts, energy FROM rows_ UNION ALL SELECT meter, ts, NULL FROM gaps)"""
CLEAN_HALF = HALF_FILLED + CHAIN.format(unit="CAST(date_trunc('hour', ts) AS TIMESTAMP)", block="'block_' || (meter % 2)")


def _cleaned_half(spark, d):
    rows = t.half_hours(spark, d).withColumn("file", F.concat(F.lit("block_"), F.col("meter") % 2))
    return clean_readings(rows, "meter", "ts", "energy", block="file")


@query("clean_half_hourly", "meter ts", "energy", sql=f"WITH {CLEAN_HALF} SELECT * FROM clean")
def clean_half_hourly(spark, d):
    return _cleaned_half(spark, d).hourly


@query("removed_ids_half_hourly", "id_removed block motive", sql=f"WITH {CLEAN_HALF} SELECT * FROM removed")
def removed_ids_half_hourly(spark, d):
    return _cleaned_half(spark, d).removed


@query("gap_lengths_half_hourly", "meter n_missing longest n_gaps", sql=f"""
WITH {HALF_FILLED},
numbered AS (SELECT meter, ts, row_number() OVER (PARTITION BY meter ORDER BY ts) AS i FROM gaps),
islands AS (SELECT meter, ts - to_minutes(CAST(30 * i AS INTEGER)) AS island, count(*) AS n FROM numbered GROUP BY ALL)
SELECT meter, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_missing, coalesce(max(n), 0) AS longest, count(n) AS n_gaps
FROM (SELECT DISTINCT meter FROM rows_) LEFT JOIN islands USING (meter) GROUP BY meter""")
def gap_lengths_half_hourly(spark, d):
    marked = prep.mark_gaps(prep.distinct_complete(t.half_hours(spark, d)), "meter", "ts", "30 minutes")
    return marked.groupBy("meter").agg(F.sum("__gap").alias("n_missing"), F.max("__gap").alias("longest"), F.count_if(F.col("__gap") > 0).alias("n_gaps"))


def _cleaned(spark, d):
    rows = t.day_slots(spark, d).withColumn("file", F.concat(F.lit("block_"), F.col("meter") % 10))
    return clean_readings(rows, "meter", "ts", "energy", step="1 DAY", unit="day", block="file")


@query("clean_hourly", "meter ts", "energy", sql=f"WITH {CLEAN} SELECT * FROM clean")
def clean_hourly(spark, d):
    return _cleaned(spark, d).hourly


@query("removed_ids", "id_removed block motive", sql=f"WITH {CLEAN} SELECT * FROM removed")
def removed_ids(spark, d):
    return _cleaned(spark, d).removed


@query("motive_shares", "motive n", "share", sql=f"""
WITH {CLEAN}
SELECT motive, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM removed GROUP BY motive""")
def motive_shares(spark, d):
    return prep.motive_shares(_cleaned(spark, d).removed)


@query("clean_enriched", "meter ts acorn_grouped acorn tariff file season", "energy temperature", sql=f"""
WITH {CLEAN},
{t.HOUSEHOLDS},
daily AS (
  SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time, avg(value) AS temperature
  FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT meter, ts, energy, temperature, acorn_grouped, acorn, tariff, file, {t.season_sql()} AS season
FROM clean LEFT JOIN daily ON ts = time LEFT JOIN households ON meter = id""")
def clean_enriched(spark, d):
    views = t.table(spark, d, "events").where(F.col("event_type") == "view")
    daily = views.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time")).agg(
        F.avg("value").alias("temperature"))
    return enrich_hourly(_cleaned(spark, d).hourly, daily, t.households(spark, d), "meter", "ts", "time", "id")


@query("winsorised", "event_id event_type", "value", sql="""
SELECT event_id, event_type,
       CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN lo WHEN value > q3 + 1.5 * (q3 - q1) THEN hi ELSE value END AS value
FROM events JOIN (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
         quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi
  FROM events GROUP BY event_type) USING (event_type)""")
def winsorised(spark, d):
    ev = t.table(spark, d, "events").select("event_id", "event_type", "value")
    return prep.winsorise(ev, "value", ["event_type"])


@query("minmax", "event_id", "value", sql="""
SELECT event_id, (value - lo) / (hi - lo) AS value
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)""")
def minmax(spark, d):
    return prep.minmax(t.table(spark, d, "events").select("event_id", "value"), "value")


@query("min_history", "meter ts", "energy", sql=f"""
WITH {t.USER_HOURLY}
SELECT * FROM user_hourly WHERE meter IN (SELECT meter FROM user_hourly GROUP BY meter HAVING count(*) >= 65)""")
def min_history(spark, d):
    return prep.min_history(t.user_hourly(spark, d), "meter", 65)


@query("key_hour_means", "meter hour", "energy", sql=f"""
WITH {t.READINGS}
SELECT meter, hour, energy FROM (SELECT DISTINCT meter FROM readings)
CROSS JOIN (SELECT DISTINCT hour(ts) AS hour FROM readings)
LEFT JOIN (SELECT meter, hour(ts) AS hour, avg(energy) AS energy FROM readings GROUP BY 1, 2) USING (meter, hour)""")
def key_hour_means(spark, d):
    return prep.key_hour_means(t.readings(spark, d), "meter", "ts", "energy")


@query("weather_joined", "meter ts", "energy temperature", sql=f"WITH {t.HOURLY_WEATHER} SELECT * FROM hourly_weather")
def weather_joined(spark, d):
    return t.hourly_weather(spark, d)


@query("weather_incomplete", "time", sql="""
SELECT time FROM (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time,
         avg(CASE WHEN event_type = 'view' THEN value END) AS temperature,
         avg(CASE WHEN event_type = 'click' THEN value END) AS humidity
  FROM events GROUP BY 1) WHERE temperature IS NULL OR humidity IS NULL""")
def weather_incomplete(spark, d):
    ev = t.table(spark, d, "events")
    wide = ev.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(
        F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("temperature"),
        F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("humidity"))
    return incomplete_rows(wide)


@query("household_joined", "meter ts acorn_grouped acorn tariff file", "energy", sql=f"""
WITH {t.USER_HOURLY},
{t.HOUSEHOLDS}
SELECT meter, ts, acorn_grouped, acorn, tariff, file, energy FROM user_hourly LEFT JOIN households ON meter = id""")
def household_joined(spark, d):
    return prep.join_households(t.user_hourly(spark, d), t.households(spark, d), "meter", "id")


@query("household_dimension", "id acorn_grouped acorn area tariff file", sql=f"WITH {t.HOUSEHOLDS} SELECT * FROM households")
def household_dimension(spark, d):
    return t.households(spark, d)


@query("ids_kept", "meter ts", "energy", sql=f"""
WITH {t.USER_HOURLY},
{t.HOUSEHOLDS}
SELECT * FROM user_hourly WHERE meter IN (SELECT id FROM households WHERE tariff = 'Std')""")
def ids_kept(spark, d):
    std = t.households(spark, d).where(F.col("tariff") == "Std")
    return prep.keep_ids(t.user_hourly(spark, d), std, "meter", "id")


@query("ids_dropped", "meter ts", "energy", sql=f"""
WITH {t.USER_HOURLY},
{t.HOUSEHOLDS}
SELECT * FROM user_hourly WHERE meter NOT IN (SELECT id FROM households WHERE tariff = 'Std')""")
def ids_dropped(spark, d):
    std = t.households(spark, d).where(F.col("tariff") == "Std")
    return prep.drop_ids(t.user_hourly(spark, d), std, "meter", "id")


@query("rows_stacked", "meter ts", "energy temperature", sql=f"""
WITH {t.HOURLY},
{t.WEATHER}
SELECT meter, ts, energy, NULL AS temperature FROM hourly
UNION ALL SELECT 'weather', time, NULL, temperature FROM weather""")
def rows_stacked(spark, d):
    w = t.weather(spark, d).select(F.lit("weather").alias("meter"), F.col("time").alias("ts"), "temperature")
    return t.hourly(spark, d).unionByName(w, allowMissingColumns=True)


@query("date_zoom", "meter ts", "energy", sql=f"""
WITH {t.USER_HOURLY}
SELECT * FROM user_hourly WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-24 00:00:00'""")
def date_zoom(spark, d):
    start = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return t.user_hourly(spark, d).where(F.col("ts").between(start, F.timestamp_add("DAY", F.lit(14), start)))


@query("calendar_keys", "hour week month quarter year monthday weekday weekend date n", sql=f"""
WITH {t.SALES}
SELECT hour(ts) AS hour, CAST(floor((dayofyear(ts) - 1) / 7.0) AS BIGINT) + 1 AS week, month(ts) AS month,
       quarter(ts) AS quarter, year(ts) AS year, day(ts) AS monthday, isodow(ts) - 1 AS weekday,
       CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Working Days' END AS weekend, CAST(ts AS DATE) AS date,
       count(*) AS n
FROM sales GROUP BY ALL""")
def calendar_keys(spark, d):
    names = ["hour", "week", "month", "quarter", "year", "monthday", "weekday", "weekend", "date"]
    return add_calendar(t.sales(spark, d), "ts").groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


@query("season_tagged", "meter ts season temporada", "energy", sql=f"""
WITH {t.SALES_HOURLY},
tagged AS (SELECT *, {t.season_sql()} AS season FROM sales_hourly)
SELECT meter, ts, season, {t.TEMPORADA} AS temporada, energy FROM tagged""")
def season_tagged(spark, d):
    out = t.sales_hourly(spark, d).withColumn("season", season_of(F.col("ts")))
    return out.withColumn("temporada", temporada_of(F.col("season")))


# --- activity at home ----------------------------------------------------------------

@query("zscored", "meter ts", "energy", sql=f"""
WITH {t.HOURLY}
SELECT meter, ts, (energy - avg(energy) OVER w) / nullif(stddev_samp(energy) OVER w, 0) AS energy
FROM hourly WINDOW w AS (PARTITION BY meter)""")
def zscored(spark, d):
    return activity.zscore(t.hourly(spark, d), "energy", ["meter"])


def _blocks_sql(src: str) -> str:
    return f"""anchor AS (SELECT date_trunc('hour', min(ts)) AS a FROM {src}),
z AS (
  SELECT meter, ts, energy, {t.season_sql()} AS season,
         (energy - avg(energy) OVER w) / nullif(stddev_samp(energy) OVER w, 0) AS z,
         a + to_hours(CAST(6 * floor(date_diff('hour', a, ts) / 6.0) AS INTEGER)) AS window_start
  FROM {src}, anchor WINDOW w AS (PARTITION BY meter)),
blocks AS (
  SELECT meter, window_start, season, var_samp(z) AS block_variance FROM z GROUP BY 1, 2, 3),
thresholds AS (
  SELECT meter, season, quantile_cont(block_variance, 0.1) AS threshold
  FROM blocks WHERE block_variance IS NOT NULL GROUP BY 1, 2),
home AS (
  SELECT z.meter, z.ts, z.energy, z.season, coalesce(block_variance, 0) >= threshold AS is_home
  FROM z JOIN blocks USING (meter, window_start, season) LEFT JOIN thresholds USING (meter, season))"""


BLOCKS = t.HOURLY + ",\n" + _blocks_sql("hourly")
REGION_BLOCKS = t.SALES_HOURLY_REGION + ",\n" + _blocks_sql("sales_hourly")


@query("block_variance", "meter window_start season", "block_variance", sql=f"WITH {BLOCKS} SELECT * FROM blocks")
def block_variance(spark, d):
    return activity.block_variance(t.hourly(spark, d), "meter", "ts", "energy")


@query("incomplete_share", "one", "incomplete_percent", sql=f"""
WITH {BLOCKS}
SELECT 1 AS one, 100 * avg(CASE WHEN block_variance IS NULL THEN 1.0 ELSE 0.0 END) AS incomplete_percent FROM blocks""")
def incomplete_share(spark, d):
    return prep.incomplete_share(block_variance(spark, d)).withColumn("one", F.lit(1))


@query("activity_threshold", "meter season", "threshold", sql=f"WITH {REGION_BLOCKS} SELECT * FROM thresholds")
def activity_threshold(spark, d):
    blocks = activity.block_variance(t.sales_hourly(spark, d, "r_name"), "meter", "ts", "energy")
    return activity.activity_threshold(blocks, "meter")


@query("is_home", "meter ts is_home", "energy", sql=f"WITH {BLOCKS} SELECT * FROM home")
def is_home(spark, d):
    return activity.detect_home(t.hourly(spark, d), "meter", "ts", "energy")


@query("is_home_by_season", "meter season is_home n", sql=f"""
WITH {REGION_BLOCKS}
SELECT meter, season, is_home, count(*) AS n FROM home GROUP BY 1, 2, 3""")
def is_home_by_season(spark, d):
    home = activity.detect_home(t.sales_hourly(spark, d, "r_name"), "meter", "ts", "energy")
    return home.groupBy("meter", "season", "is_home").agg(F.count(F.lit(1)).alias("n"))
