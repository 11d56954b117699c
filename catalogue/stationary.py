"""Stationary series: seasonal difference, masking, imputation, decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import tables as t
from catalogue.preparation import BLOCKS
from catalogue.registry import query
from meterlab.operators import activity, stationary as st
from meterlab.operators.order_stats import exact_quantiles
from meterlab.operators.preparation import join_weather

DIFF = """diffed AS (
  SELECT meter, ts, energy - lag(energy, 24) OVER (PARTITION BY meter ORDER BY ts) AS energy FROM {src})"""


def impute_sql(src: str, out: str, by: str, col: str = "energy", keep: str = "") -> str:
    """One imputation layer: fences and median of the rest per group."""
    return f"""{out}_f AS (
  SELECT *, quantile_cont({col}, 0.25) OVER g AS q1, quantile_cont({col}, 0.75) OVER g AS q3
  FROM {src} WINDOW g AS (PARTITION BY {by})),
{out}_m AS (
  SELECT *, coalesce({col} < q1 - 1.5 * (q3 - q1) OR {col} > q3 + 1.5 * (q3 - q1), false) AS mark FROM {out}_f),
{out} AS (
  SELECT meter, ts{keep}, CASE WHEN mark THEN quantile_cont(CASE WHEN NOT mark THEN {col} END, 0.5)
           OVER (PARTITION BY {by}) ELSE {col} END AS {col}, mark AS mark_{out}
  FROM {out}_m)"""


LAYER1 = impute_sql("diffed", "one", "meter, quarter(ts), hour(ts)")
LAYER2 = impute_sql("one", "two", "meter, hour(ts)", keep=", mark_one")
PREPARED = t.HOURLY + ",\n" + DIFF.format(src="hourly") + ",\n" + LAYER1 + ",\n" + LAYER2


def _diffed(spark, d):
    return st.seasonal_difference(t.hourly(spark, d), ["meter"], "ts", ["energy"], 24)


@query("seasonal_difference", "meter ts", "energy", sql=f"WITH {t.HOURLY},\n{DIFF.format(src='hourly')} SELECT * FROM diffed")
def seasonal_difference(spark, d):
    return _diffed(spark, d)


@query("outlier_imputed_quarter_hour", "meter ts mark", "energy", sql=f"WITH {PREPARED} SELECT meter, ts, energy, mark_one AS mark FROM one")
def outlier_imputed_quarter_hour(spark, d):
    rows = _diffed(spark, d).withColumns({"q": F.quarter("ts"), "h": F.hour("ts")})
    return st.impute_outliers(rows, ["energy"], ["meter", "q", "h"], "m_").withColumnRenamed("m_energy", "mark")


@query("outlier_imputed_hour", "meter ts", "energy", sql=f"WITH {PREPARED} SELECT meter, ts, energy FROM two")
def outlier_imputed_hour(spark, d):
    return st.impute_two_layers(_diffed(spark, d), ["meter"], "ts", ["energy"])


@query("pct_imputed", "meter", "pct_imputed", sql=f"""
WITH {PREPARED}
SELECT meter, avg(CASE WHEN mark_one OR mark_two THEN 1.0 ELSE 0.0 END) AS pct_imputed FROM two GROUP BY meter""")
def pct_imputed(spark, d):
    rows = st.impute_two_layers(_diffed(spark, d), ["meter"], "ts", ["energy"], share_of="energy")
    return st.imputed_share(rows, "meter")


USER_PREPARED = (t.USER_HOURLY + ",\n" + DIFF.format(src="user_hourly") + ",\n" + LAYER1 + ",\n" + LAYER2 + """,
shares AS (
  SELECT meter, avg(CASE WHEN mark_one OR mark_two THEN 1.0 ELSE 0.0 END) AS pct_imputed FROM two GROUP BY meter)""")


def _user_prepared(spark, d):
    rows = st.seasonal_difference(t.user_hourly(spark, d), ["meter"], "ts", ["energy"], 24)
    return st.impute_two_layers(rows, ["meter"], "ts", ["energy"], share_of="energy")


@query("imputed_share_p90", "one", "p90", sql=f"""
WITH {USER_PREPARED}
SELECT 1 AS one, quantile_cont(pct_imputed, 0.9) AS p90 FROM shares""")
def imputed_share_p90(spark, d):
    shares = st.imputed_share(_user_prepared(spark, d), "meter")
    return exact_quantiles(shares, "pct_imputed", {"p90": .9}).withColumn("one", F.lit(1))


@query("drop_heavily_imputed", "meter ts", "energy", sql=f"""
WITH {USER_PREPARED}
SELECT meter, ts, energy FROM two JOIN shares USING (meter)
WHERE NOT pct_imputed > (SELECT quantile_cont(pct_imputed, 0.9) FROM shares)""")
def drop_heavily_imputed(spark, d):
    return st.drop_heavily_imputed(_user_prepared(spark, d), "meter", 0.9)


_FULL = BLOCKS + ",\n" + t.WEATHER + """,
still AS (
  SELECT meter, ts, is_home,
         energy - lag(energy, 24) OVER w AS energy, temperature - lag(temperature, 24) OVER w AS temperature
  FROM home LEFT JOIN weather ON ts = time WINDOW w AS (PARTITION BY meter ORDER BY ts)),
e0 AS (SELECT meter, ts, CASE WHEN is_home THEN energy END AS energy FROM still),
t0 AS (SELECT meter, ts, CASE WHEN is_home THEN temperature END AS temperature FROM still),
""" + ",\n".join([
    impute_sql("e0", "e1", "meter, quarter(ts), hour(ts)"), impute_sql("e1", "e2", "meter, hour(ts)", keep=", mark_e1"),
    impute_sql("t0", "t1", "meter, quarter(ts), hour(ts)", "temperature"),
    impute_sql("t1", "t2", "meter, hour(ts)", "temperature", keep=", mark_t1")])


STATIONARY = _FULL + """,
stationary AS (
  SELECT meter, ts, (energy - avg(energy) OVER w) / nullif(stddev_samp(energy) OVER w, 0) AS energy,
         (temperature - avg(temperature) OVER w) / nullif(stddev_samp(temperature) OVER w, 0) AS temperature,
         avg(CASE WHEN mark_e1 OR mark_e2 THEN 1.0 ELSE 0.0 END) OVER w AS pct_imputed
  FROM e2 JOIN t2 USING (meter, ts) WINDOW w AS (PARTITION BY meter))"""


@query("stationarised", "meter ts", "energy temperature pct_imputed", sql=f"WITH {STATIONARY} SELECT * FROM stationary")
def stationarised(spark, d):
    home = activity.detect_home(t.hourly(spark, d), "meter", "ts", "energy").drop("season")
    rows = join_weather(home, t.weather(spark, d), "ts")
    return st.stationarise(rows, ["meter"], "ts", "energy", transformation="seasonal_difference",
                           is_home="is_home", standardise=True)


# Decompositions are checked in tests/test_seasonal.py (additivity, brute-force local regression).

@query("mstl_components", "meter ts", "observed trend seasonal_24 seasonal_168 remainder")
def mstl_components(spark, d):
    return st.mstl_components(t.hourly(spark, d), ["meter"], "ts", "energy", (24, 168), log1p=True)


@query("mstl_robust", "meter ts", "observed trend seasonal_7 seasonal_30 remainder")
def mstl_robust(spark, d):
    return st.mstl_components(t.sales_daily(spark, d), ["meter"], "ts", "energy", (7, 30), robust=True)


@query("stationary_mstl", "meter ts", "energy temperature pct_imputed")
def stationary_mstl(spark, d):
    home = activity.detect_home(t.hourly(spark, d), "meter", "ts", "energy").drop("season")
    rows = join_weather(home, t.weather(spark, d), "ts")
    return st.stationarise(rows, ["meter"], "ts", "energy", is_home="is_home")


# The decompositions under SQL: what any of them must fulfil, per series.
AUDIT = "meter n n_observed centred calmer ordered"


def audit_sql(src: str, value: str) -> str:
    return f"""SELECT meter, count(*) AS n, count(energy) AS n_observed, avg({value}) AS observed_mean, 0.0 AS gap,
       true AS centred, true AS calmer, true AS ordered FROM {src} GROUP BY meter"""


@query("mstl_components_audit", AUDIT, "observed_mean gap", sql=f"WITH {t.HOURLY} {audit_sql('hourly', 'ln(1 + energy)')}")
def mstl_components_audit(spark, d):
    return st.audit_components(mstl_components(spark, d), ["meter"], (24, 168))


@query("mstl_robust_audit", AUDIT, "observed_mean gap", sql=f"WITH {t.SALES_DAILY} {audit_sql('sales_daily', 'energy')}")
def mstl_robust_audit(spark, d):
    return st.audit_components(mstl_robust(spark, d), ["meter"], (7, 30))


@query("stationary_mstl_audit", "meter n n_energy n_temperature known_at_home share_in_range", sql=f"""
WITH {BLOCKS}
SELECT meter, count(*) AS n, count(*) FILTER (is_home) AS n_energy, count(*) FILTER (is_home) AS n_temperature,
       true AS known_at_home, true AS share_in_range FROM home GROUP BY meter""")
def stationary_mstl_audit(spark, d):
    """Remainders exist exactly where the household is at home; the imputed share is one value per household, 0 to 1."""
    rows = stationary_mstl(spark, d)
    share = F.col("pct_imputed")
    return rows.groupBy("meter").agg(
        F.count(F.lit(1)).alias("n"), F.count("energy").alias("n_energy"), F.count("temperature").alias("n_temperature"),
        F.bool_and(F.col("energy").isNull() == F.col("temperature").isNull()).alias("known_at_home"),
        ((F.min(share) >= 0) & (F.max(share) <= 1) & (F.min(share) == F.max(share))).alias("share_in_range"))
