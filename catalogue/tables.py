"""The roles of the analysis played by the test tables, in Spark and in SQL.

readings    events: meter = user, energy = value
meters      events of a customer's nation, hourly (25 meters)
weather     hourly mean of the ``view`` events, seen by all meters
households  customer with nation, region, segment
sales       line items by nation or region of the supplier, with an hour of day
            taken from the order key: several years, all four seasons
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlab.operators.preparation import downsample


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def readings(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("meter"), "ts", F.col("value").alias("energy"))


READINGS = "readings AS (SELECT user_id AS meter, ts, value AS energy FROM events)"


def day_slots(spark, d):
    r = readings(spark, d)
    return r.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))


DAY_SLOTS = """day_slots AS (
  SELECT user_id AS meter, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, value AS energy FROM events)"""


def hour_slots(spark, d):
    """Five meters (event types) with a dense hourly grid."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("meter"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("energy"))


HOUR_SLOTS = """hour_slots AS (
  SELECT event_type AS meter, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, value AS energy FROM events)"""


def half_hours(spark, d):
    """Five meters of very different density (45, 30, 15, 7 and 3 % of the users) on half-hour slots."""
    u, at = F.pmod("user_id", F.lit(100)), F.col("ts")
    meter = F.when(u < 45, 1).when(u < 75, 2).when(u < 90, 3).when(u < 97, 4).otherwise(5).cast("bigint")
    half = F.timestamp_add("MINUTE", F.floor(F.minute(at) / 30).cast("int") * 30, F.date_trunc("hour", at).cast("timestamp_ntz"))
    return table(spark, d, "events").select(meter.alias("meter"), half.cast("timestamp_ntz").alias("ts"), F.col("value").alias("energy"))


HALF_HOURS = """half_hours AS (
  SELECT CAST(CASE WHEN user_id % 100 < 45 THEN 1 WHEN user_id % 100 < 75 THEN 2 WHEN user_id % 100 < 90 THEN 3
                   WHEN user_id % 100 < 97 THEN 4 ELSE 5 END AS BIGINT) AS meter,
         CAST(time_bucket(INTERVAL 30 MINUTE, ts) AS TIMESTAMP) AS ts, value AS energy FROM events)"""


def user_hourly(spark, d):
    return downsample(readings(spark, d), "meter", "ts", "energy")


USER_HOURLY = """user_hourly AS (
  SELECT user_id AS meter, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, avg(value) AS energy
  FROM events GROUP BY 1, 2)"""


def households(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("acorn_grouped"),
                    F.col("n_name").alias("acorn"), F.col("r_name").alias("area"),
                    F.when(F.col("c_acctbal") < 0, "ToU").otherwise("Std").alias("tariff"),
                    F.concat(F.lit("block_"), F.col("c_custkey") % 10).alias("file")))


HOUSEHOLDS = """households AS (
  SELECT c_custkey AS id, c_mktsegment AS acorn_grouped, n_name AS acorn, r_name AS area,
         CASE WHEN c_acctbal < 0 THEN 'ToU' ELSE 'Std' END AS tariff,
         'block_' || (c_custkey % 10) AS file
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def hourly(spark, d):
    """All events per nation and hour."""
    ev, hh = table(spark, d, "events"), households(spark, d).select("id", F.col("acorn").alias("meter"))
    joined = ev.join(hh, ev.user_id == hh.id)
    return downsample(joined.select("meter", "ts", F.col("value").alias("energy")), "meter", "ts", "energy")


HOURLY = HOUSEHOLDS + """,
hourly AS (
  SELECT acorn AS meter, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, avg(value) AS energy
  FROM events JOIN households ON user_id = id GROUP BY 1, 2)"""


def weather(spark, d):
    ev = table(spark, d, "events").where(F.col("event_type") == "view")
    return (ev.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"))
            .agg(F.avg("value").alias("temperature")))


WEATHER = """weather AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time, avg(value) AS temperature
  FROM events WHERE event_type = 'view' GROUP BY 1)"""


def hourly_weather(spark, d):
    from meterlab.operators.preparation import join_weather

    return join_weather(hourly(spark, d), weather(spark, d), "ts")


HOURLY_WEATHER = HOURLY + ",\n" + WEATHER + """,
hourly_weather AS (
  SELECT meter, ts, energy, temperature FROM hourly LEFT JOIN weather ON ts = time)"""


def sales(spark, d, level="n_name"):
    """Line items with a meter (nation or region of the supplier) and an hourly timestamp."""
    li, s, n, r = (table(spark, d, t) for t in ("lineitem", "supplier", "nation", "region"))
    geo = (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
           .select("s_suppkey", F.col(level).alias("meter")))
    return li.join(geo, li.l_suppkey == geo.s_suppkey).select(
        "meter", F.timestamp_add("HOUR", F.col("l_orderkey") % 24, F.col("l_shipdate")).alias("ts"),
        F.col("l_extendedprice").alias("energy"), F.col("l_quantity").alias("temperature"),
        F.col("l_tax").alias("humidity"))


def _sales_sql(level: str) -> str:
    return f"""sales AS (
  SELECT {level} AS meter, l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS ts,
         l_extendedprice AS energy, l_quantity AS temperature, l_tax AS humidity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


SALES, SALES_REGION = _sales_sql("n_name"), _sales_sql("r_name")


def sales_hourly(spark, d, level="n_name"):
    return downsample(sales(spark, d, level), "meter", "ts", ["energy", "temperature", "humidity"])


_SALES_HOURLY = """,
sales_hourly AS (
  SELECT meter, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, avg(energy) AS energy,
         avg(temperature) AS temperature, avg(humidity) AS humidity
  FROM sales GROUP BY 1, 2)"""
SALES_HOURLY, SALES_HOURLY_REGION = SALES + _SALES_HOURLY, SALES_REGION + _SALES_HOURLY


def sales_daily(spark, d):
    """Daily means per region of the supplier."""
    return downsample(sales(spark, d, "r_name"), "meter", "ts", ["energy", "temperature", "humidity"], "day")


SALES_DAILY = SALES_REGION + """,
sales_daily AS (
  SELECT meter, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, avg(energy) AS energy,
         avg(temperature) AS temperature, avg(humidity) AS humidity
  FROM sales GROUP BY 1, 2)"""

def population(spark, d, unit="hour"):
    """One population-mean series over all line items; the discount plays the apparent temperature."""
    at = F.timestamp_add("HOUR", F.col("l_orderkey") % 24, F.col("l_shipdate"))
    return table(spark, d, "lineitem").groupBy(F.date_trunc(unit, at).cast("timestamp_ntz").alias("ts")).agg(
        F.avg("l_extendedprice").alias("energy"), F.avg("l_quantity").alias("temperature"),
        F.avg("l_discount").alias("apparent"), F.avg("l_tax").alias("humidity"))


POPULATION_DAYS = """population AS (
  SELECT 0 AS meter, CAST(date_trunc('day', l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER))) AS TIMESTAMP) AS ts,
         avg(l_extendedprice) AS energy, avg(l_quantity) AS temperature, avg(l_discount) AS apparent, avg(l_tax) AS humidity
  FROM lineitem GROUP BY 1, 2)"""

SEASON = """CASE WHEN month({0}) IN (3, 4, 5) THEN 'Spring' WHEN month({0}) IN (6, 7, 8) THEN 'Summer'
     WHEN month({0}) IN (9, 10, 11) THEN 'Autumn' ELSE 'Winter' END"""


def season_sql(ts: str = "ts") -> str:
    return SEASON.format(ts)


TEMPORADA = "CASE WHEN season = 'Summer' THEN 'warm' ELSE 'cold' END"
