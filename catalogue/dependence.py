"""Lag correlations, generalised cross-correlation, ranking, bootstrap."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalogue import tables as t
from catalogue.profiles import box_sql, density_sql
from catalogue.registry import query
from catalogue.stationary import STATIONARY, stationarised as stationary_rows
from meterlab.functions.calendar import season_of, temporada_of
from meterlab.operators import bootstrap as bs, dependence as dep, profiles as pf
from meterlab.plans import ranking as plan
from meterlab.sources.stages import materialise


# --- SQL building blocks ------------------------------------------------------------------

def week_sql(src: str, keys: str = "meter") -> str:
    """Typical week with row positions, scaled per key."""
    return f"""cells AS (
  SELECT {keys}, isodow(ts) - 1 AS day_of_week, hour(ts) AS hour, avg(energy) AS x, avg(temperature) AS y
  FROM {src} GROUP BY ALL),
week AS (
  SELECT {keys}, day_of_week, hour, row_number() OVER (PARTITION BY {keys} ORDER BY day_of_week, hour) - 1 AS pos,
         round((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 9) AS x,
         round((y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0), 9) AS y
  FROM cells WINDOW w AS (PARTITION BY {keys}))"""


def lags_sql(src: str, keys: str, k: int, method: str) -> str:
    """All lag correlations of ``src(keys, pos, x, y)``."""
    pairs = f"""pairs AS (
  SELECT {keys}, kind, lag, a, b FROM (
    SELECT {keys}, 'xx' AS kind, l AS lag, x AS a, lead(x, l) OVER w AS b FROM {src}, (SELECT unnest(range(1, {k + 1})) AS l)
      WINDOW w AS (PARTITION BY {keys}, l ORDER BY pos)
    UNION ALL SELECT {keys}, 'yy', l, y, lead(y, l) OVER w FROM {src}, (SELECT unnest(range(1, {k + 1})) AS l)
      WINDOW w AS (PARTITION BY {keys}, l ORDER BY pos)
    UNION ALL SELECT {keys}, 'xy', l, x, lead(y, l) OVER w FROM {src}, (SELECT unnest(range(0, {k + 1})) AS l)
      WINDOW w AS (PARTITION BY {keys}, l ORDER BY pos)
    UNION ALL SELECT {keys}, 'yx', l, y, lead(x, l) OVER w FROM {src}, (SELECT unnest(range(1, {k + 1})) AS l)
      WINDOW w AS (PARTITION BY {keys}, l ORDER BY pos))
  WHERE a IS NOT NULL AND b IS NOT NULL),
"""
    use = "pairs"
    if method == "spearman":
        pairs += f"""ranked AS (
  SELECT {keys}, kind, lag,
         rank() OVER (PARTITION BY {keys}, kind, lag ORDER BY a)
           + (count(*) OVER (PARTITION BY {keys}, kind, lag, a) - 1) / 2.0 AS a,
         rank() OVER (PARTITION BY {keys}, kind, lag ORDER BY b)
           + (count(*) OVER (PARTITION BY {keys}, kind, lag, b) - 1) / 2.0 AS b
  FROM pairs),
"""
        use = "ranked"
    return pairs + f"""lags AS (
  SELECT {keys}, kind, lag, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS rho
  FROM {use} GROUP BY {keys}, kind, lag)"""


def gcc_k1_sql(keys: str) -> str:
    """Closed form for one lag, from ``lags``."""
    def pick(kind: str, lag: int) -> str:
        return f"max(CASE WHEN kind = '{kind}' AND lag = {lag} THEN rho END)"

    return f"""coef AS (
  SELECT {keys}, {pick('xx', 1)} AS a, {pick('yy', 1)} AS b, {pick('xy', 0)} AS c0, {pick('xy', 1)} AS c1,
         {pick('yx', 1)} AS cm FROM lags GROUP BY {keys}),
minors AS (
  SELECT *, 1 - (c0 * c0 - 2 * a * c0 * cm + cm * cm) / (1 - a * a) AS m11,
         1 - (c1 * c1 - 2 * a * c1 * c0 + c0 * c0) / (1 - a * a) AS m22,
         b - (c0 * c1 - a * (c0 * c0 + cm * c1) + cm * c0) / (1 - a * a) AS m12 FROM coef),
scores AS (
  SELECT {keys}, CASE WHEN (m11 * m22 - m12 * m12) / (1 - b * b) > 0
                      THEN 1 - sqrt((m11 * m22 - m12 * m12) / (1 - b * b)) END AS gcc FROM minors)"""


def gcc_sql(keys: str, k: int, out: str = "scores") -> str:
    """Any number of lags, from ``lags``: log-determinants by elimination in a recursive query.

    det(R_yy - C R_xx^-1 C') = det [[R_xx, C'], [C, R_yy]] / det R_xx.
    """
    m = k + 1
    pick = ", ".join(
        f"list_value({', '.join(['1.0' if kind in ('xx', 'yy') else _one(kind, 0)] + [_one(kind, h) for h in range(1, m)])}) AS {kind}"
        for kind in ("xx", "yy", "xy", "yx"))
    lag = "abs(i - j)"
    cell_c = f"CASE WHEN i >= j THEN xy[i - j + 1] ELSE yx[j - i + 1] END"

    def matrix(rows: int, cell: str) -> str:
        return f"list_transform(range({rows}), lambda i: list_transform(range({rows}), lambda j: {cell}))"

    whole = (f"CASE WHEN i < {m} AND j < {m} THEN xx[abs(i - j) + 1] WHEN i >= {m} AND j >= {m} THEN yy[abs(i - j) + 1] "
             f"WHEN i >= {m} THEN CASE WHEN i - {m} >= j THEN xy[i - {m} - j + 1] ELSE yx[j - i + {m} + 1] END "
             f"ELSE CASE WHEN j - {m} >= i THEN xy[j - {m} - i + 1] ELSE yx[i - j + {m} + 1] END END")
    return f"""lists AS (SELECT {keys}, {pick} FROM lags GROUP BY {keys}),
mats AS (
  SELECT {keys}, 'w' AS part, {matrix(2 * m, whole)} AS a FROM lists
  UNION ALL SELECT {keys}, 'x', {matrix(m, 'xx[abs(i - j) + 1]')} FROM lists
  UNION ALL SELECT {keys}, 'y', {matrix(m, 'yy[abs(i - j) + 1]')} FROM lists),
elim AS (
  SELECT {keys}, part, a, 0.0::DOUBLE AS logdet FROM mats
  UNION ALL
  SELECT {keys}, part,
         list_transform(a[2:], lambda r: list_transform(range(2, len(a) + 1), lambda j: r[j] - r[1] * a[1][j] / a[1][1])) AS a,
         logdet + ln(a[1][1]) AS logdet
  FROM elim WHERE len(a) > 0 AND a[1][1] > 0),
dets AS (SELECT {keys}, part, logdet FROM elim WHERE len(a) = 0),
{out} AS (
  SELECT {keys}, 1 - exp((max(CASE WHEN part = 'w' THEN logdet END) - max(CASE WHEN part = 'x' THEN logdet END)
                        - max(CASE WHEN part = 'y' THEN logdet END)) / {m}.0) AS gcc
  FROM dets GROUP BY {keys})"""


def _one(kind: str, lag: int) -> str:
    return f"max(CASE WHEN kind = '{kind if lag else 'xy'}' AND lag = {lag} THEN rho END)"


# --- typical week and lag correlations ---------------------------------------------------------

WEEK = t.HOURLY_WEATHER + ",\n" + week_sql("hourly_weather")


def _week(spark, d):
    return dep.typical_week(t.hourly_weather(spark, d), ["meter"], "ts", "energy", "temperature")


@query("typical_week", "meter day_of_week hour pos", "energy temperature", sql=f"""
WITH {WEEK}
SELECT meter, day_of_week, hour, pos, x AS energy, y AS temperature FROM week""")
def typical_week(spark, d):
    return _week(spark, d)


@query("lag_correlations_pearson", "meter kind lag", "rho", sql=f"""
WITH {WEEK},
{lags_sql('week', 'meter', 3, 'pearson')}
SELECT * FROM lags WHERE rho IS NOT NULL""")
def lag_correlations_pearson(spark, d):
    return dep.lag_correlations(_week(spark, d), ["meter"], "pos", "energy", "temperature", 3, "pearson").where(
        F.col("rho").isNotNull())


@query("lag_correlations_spearman", "meter kind lag", "rho", sql=f"""
WITH {WEEK},
{lags_sql('week', 'meter', 3, 'spearman')}
SELECT * FROM lags WHERE rho IS NOT NULL""")
def lag_correlations_spearman(spark, d):
    return dep.lag_correlations(_week(spark, d), ["meter"], "pos", "energy", "temperature", 3, "spearman").where(
        F.col("rho").isNotNull())


@query("gcc_k0", "meter", "gcc", sql=f"""
WITH {WEEK},
{lags_sql('week', 'meter', 0, 'spearman')}
SELECT meter, rho * rho AS gcc FROM lags""")
def gcc_k0(spark, d):
    lags = dep.lag_correlations(_week(spark, d), ["meter"], "pos", "energy", "temperature", 0, "spearman")
    return dep.gcc_closed_form(lags, ["meter"], 0)


K1 = WEEK + ",\n" + lags_sql("week", "meter", 1, "spearman") + ",\n" + gcc_k1_sql("meter")


@query("gcc_k1", "meter", "gcc", sql=f"WITH {K1} SELECT * FROM scores")
def gcc_k1(spark, d):
    lags = dep.lag_correlations(_week(spark, d), ["meter"], "pos", "energy", "temperature", 1, "spearman")
    return dep.gcc_closed_form(lags, ["meter"], 1)


@query("gcc_k1_pearson", "meter", "gcc", sql=f"""
WITH {WEEK},
{lags_sql('week', 'meter', 1, 'pearson')},
{gcc_k1_sql('meter')}
SELECT * FROM scores""")
def gcc_k1_pearson(spark, d):
    return dep.gcc(_week(spark, d), ["meter"], "pos", "energy", "temperature", 1, "pearson")


@query("gcc_k24", "meter", "gcc", sql=f"""
WITH RECURSIVE {WEEK},
{lags_sql('week', 'meter', 24, 'spearman')},
{gcc_sql('meter', 24)}
SELECT * FROM scores WHERE gcc IS NOT NULL""")
def gcc_k24(spark, d):
    scores = dep.gcc(_week(spark, d), ["meter"], "pos", "energy", "temperature", 24, "spearman")
    return scores.where(F.col("valid"))


# --- ranking ------------------------------------------------------------------------------------

SEASON_WEEK = t.SALES_HOURLY + f""",
seasoned AS (SELECT *, {t.season_sql()} AS season FROM sales_hourly),
halves AS (SELECT *, {t.TEMPORADA} AS temporada FROM seasoned),
""" + week_sql("halves", "meter, temporada")
SEASON_SCORES = SEASON_WEEK + ",\n" + lags_sql("week", "meter, temporada", 1, "spearman") + ",\n" + gcc_k1_sql("meter, temporada")


def _seasoned(spark, d):
    return t.sales_hourly(spark, d).withColumn("season", season_of(F.col("ts")))


@query("gcc_by_season_k1", "meter temporada", "gcc", sql=f"WITH {SEASON_SCORES} SELECT * FROM scores")
def gcc_by_season_k1(spark, d):
    return dep.gcc_by_household(_seasoned(spark, d), "meter", "ts", "energy", "temperature", 1)


@query("ranking_by_season", "meter temporada ranking", "gcc", sql=f"""
WITH {SEASON_SCORES}
SELECT meter, temporada, gcc, rank() OVER (PARTITION BY temporada ORDER BY gcc DESC) AS ranking FROM scores
WHERE gcc IS NOT NULL UNION ALL SELECT meter, temporada, gcc, NULL FROM scores WHERE gcc IS NULL""")
def ranking_by_season(spark, d):
    return plan.household_ranking(_seasoned(spark, d), "meter", "ts", "energy", "temperature", 1)


@query("ranking_by_season_k24", "meter temporada ranking", "gcc", sql=f"""
WITH RECURSIVE {SEASON_WEEK},
{lags_sql('week', 'meter, temporada', 24, 'spearman')},
{gcc_sql('meter, temporada', 24)}
SELECT meter, temporada, gcc, rank() OVER (PARTITION BY temporada ORDER BY gcc DESC) AS ranking FROM scores WHERE gcc IS NOT NULL""")
def ranking_by_season_k24(spark, d):
    scores = dep.gcc_by_household(_seasoned(spark, d), "meter", "ts", "energy", "temperature", 24)
    return dep.rank_households(materialise(scores.where("valid")), ["temporada"])


@query("ranking_stationary_k24", "meter ranking", "gcc", sql=f"""
WITH RECURSIVE {STATIONARY},
{week_sql('stationary')},
{lags_sql('week', 'meter', 24, 'spearman')},
{gcc_sql('meter', 24)}
SELECT meter, gcc, rank() OVER (ORDER BY gcc DESC) AS ranking FROM scores WHERE gcc IS NOT NULL""")
def ranking_stationary_k24(spark, d):
    """Stationary, home-masked series -> typical weeks -> GCC over 24 lags -> ranking."""
    scores = dep.gcc_by_household(stationary_rows(spark, d), "meter", "ts", "energy", "temperature", 24, by_seasons=False)
    return dep.rank_households(materialise(scores.where("valid")))


COMPLETE = """
SELECT {keys}, gcc, CASE WHEN gcc IS NOT NULL THEN rank() OVER ({part}ORDER BY gcc DESC NULLS LAST) END AS ranking FROM scores"""


def _complete(scores):
    """Scores of all meters; those whose correlation matrices are not positive definite have none and no rank."""
    return materialise(scores.withColumn("gcc", F.when(F.col("valid"), F.col("gcc"))))


@query("ranking_by_season_k24_complete", "meter temporada ranking", "gcc", sql=f"""
WITH RECURSIVE {SEASON_WEEK},
{lags_sql('week', 'meter, temporada', 24, 'spearman')},
{gcc_sql('meter, temporada', 24)}""" + COMPLETE.format(keys="meter, temporada", part="PARTITION BY temporada "))
def ranking_by_season_k24_complete(spark, d):
    scores = dep.gcc_by_household(_seasoned(spark, d), "meter", "ts", "energy", "temperature", 24)
    return dep.rank_households(_complete(scores), ["temporada"])


@query("ranking_stationary_k24_complete", "meter ranking", "gcc", sql=f"""
WITH RECURSIVE {STATIONARY},
{week_sql('stationary')},
{lags_sql('week', 'meter', 24, 'spearman')},
{gcc_sql('meter', 24)}""" + COMPLETE.format(keys="meter", part=""))
def ranking_stationary_k24_complete(spark, d):
    """All households of the stationary, home-masked series, also those without a valid GCC over 24 lags."""
    scores = dep.gcc_by_household(stationary_rows(spark, d), "meter", "ts", "energy", "temperature", 24, by_seasons=False)
    return dep.rank_households(_complete(scores))


RANKED = K1 + """,
ranked_scores AS (
  SELECT meter, gcc, CASE WHEN gcc IS NOT NULL THEN rank() OVER (ORDER BY gcc DESC NULLS LAST) END AS ranking
  FROM scores)"""


def _ranking(spark, d):
    return plan.household_ranking(t.hourly_weather(spark, d), "meter", "ts", "energy", "temperature", 1, by_seasons=False)


@query("ranking", "meter ranking", "gcc", sql=f"WITH {RANKED} SELECT * FROM ranked_scores")
def ranking(spark, d):
    return _ranking(spark, d)


@query("ranking_enriched", "meter ranking area n_households", "gcc", sql=f"""
WITH {RANKED},
attributes AS (SELECT acorn, any_value(area) AS area, count(*) AS n_households FROM households GROUP BY acorn)
SELECT meter, ranking, gcc, area, n_households FROM ranked_scores LEFT JOIN attributes ON meter = acorn""")
def ranking_enriched(spark, d):
    attributes = t.households(spark, d).groupBy("acorn").agg(
        F.min("area").alias("area"), F.count(F.lit(1)).alias("n_households"))
    return dep.enrich_ranking(_ranking(spark, d), attributes, "meter", "acorn")


@query("top_households", "meter ranking", "gcc", sql=f"""
WITH {RANKED} SELECT * FROM ranked_scores WHERE ranking IS NOT NULL ORDER BY ranking LIMIT 10""")
def top_households(spark, d):
    return dep.top_households(_ranking(spark, d), 10)


AREA_SCORES = RANKED + """,
area_scores AS (
  SELECT area, gcc FROM ranked_scores JOIN (SELECT DISTINCT acorn, area FROM households) ON meter = acorn)"""


def _area_scores(spark, d):
    areas = t.households(spark, d).select(F.col("acorn").alias("meter"), "area").distinct()
    lags = dep.lag_correlations(_week(spark, d), ["meter"], "pos", "energy", "temperature", 1, "spearman")
    return dep.gcc_closed_form(lags, ["meter"], 1).join(areas, "meter")


@query("gcc_box_by_group", "area n n_outliers", "q1 median q3 lower_whisker upper_whisker", sql=f"""
WITH {AREA_SCORES}
{box_sql('area_scores', 'gcc', 'area')}""")
def gcc_box_by_group(spark, d):
    return plan.gcc_profile(_area_scores(spark, d), "area")[0]


@query("gcc_density_by_group", "area point", "x density", sql=f"""
WITH {AREA_SCORES},
{density_sql('area_scores', 'gcc', 'area', 64)}
SELECT * FROM density""")
def gcc_density_by_group(spark, d):
    return plan.gcc_profile(_area_scores(spark, d), "area", points=64)[1]


# --- population series, pairs, bootstrap ------------------------------------------------------------

def _layers(col: str, src: str) -> str:
    from catalogue.stationary import impute_sql

    return ",\n".join([
        f"{col}_0 AS (SELECT meter, ts, {col} FROM {src})",
        impute_sql(f"{col}_0", f"{col}_1", "meter, quarter(ts), hour(ts)", col),
        impute_sql(f"{col}_1", f"{col}_2", "meter, hour(ts)", col)])


DAILY = t.SALES_DAILY + """,
still AS (
  SELECT meter, ts, energy - lag(energy, 24) OVER w AS energy, temperature - lag(temperature, 24) OVER w AS temperature,
         humidity - lag(humidity, 24) OVER w AS humidity
  FROM sales_daily WINDOW w AS (PARTITION BY meter ORDER BY ts)),
""" + ",\n".join(_layers(c, "still") for c in ("energy", "temperature", "humidity")) + f""",
days AS (
  SELECT meter, CAST(ts AS DATE) AS date,
         CASE WHEN count(energy) = count(*) THEN avg(energy) END AS energy,
         CASE WHEN count(temperature) = count(*) THEN avg(temperature) END AS temperature,
         CASE WHEN count(humidity) = count(*) THEN avg(humidity) END AS humidity
  FROM energy_2 JOIN temperature_2 USING (meter, ts) JOIN humidity_2 USING (meter, ts) GROUP BY 1, 2),
scaled AS (
  SELECT meter, date, (energy - avg(energy) OVER w) / nullif(stddev_samp(energy) OVER w, 0) AS energy,
         (temperature - avg(temperature) OVER w) / nullif(stddev_samp(temperature) OVER w, 0) AS temperature,
         (humidity - avg(humidity) OVER w) / nullif(stddev_samp(humidity) OVER w, 0) AS humidity,
         {t.season_sql('date')} AS season
  FROM days WINDOW w AS (PARTITION BY meter)),
daily AS (SELECT *, {t.TEMPORADA} AS temporada FROM scaled)"""


def _daily(spark, d):
    return plan.daily_stationary(t.sales_daily(spark, d), "ts", "energy", "seasonal_difference", ["meter"])


@query("daily_stationary", "meter date season temporada", "energy temperature humidity", sql=f"WITH {DAILY} SELECT * FROM daily")
def daily_stationary(spark, d):
    return _daily(spark, d)


PAIRS = [("energy", "temperature"), ("energy", "humidity"), ("temperature", "humidity")]


@query("run_pairs_k1", "meter pair", "gcc", sql=f"""
WITH {DAILY},
placed AS (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY date) AS pos FROM daily),
long AS (
""" + " UNION ALL ".join(f"  SELECT meter, '{a}~{b}' AS pair, pos, round({a}, 9) AS x, round({b}, 9) AS y FROM placed" for a, b in PAIRS) + f"""),
{lags_sql('long', 'meter, pair', 1, 'spearman')},
{gcc_k1_sql('meter, pair')}
SELECT * FROM scores""")
def run_pairs_k1(spark, d):
    # Rounded so that values equal up to float noise are ties for the ranks.
    rounded = {c: F.round(c, 9) for c in ("energy", "temperature", "humidity")}
    placed = _daily(spark, d).withColumns(rounded).withColumn("pos", F.row_number().over(Window.partitionBy("meter").orderBy("date")))
    return dep.run_pairs(placed, ["meter"], "pos", PAIRS, 1)


def _boot_series(spark, d):
    rows = t.sales(spark, d).withColumn("date", F.to_date("ts"))
    day = rows.groupBy("date").agg(F.avg("energy").alias("energy"), F.avg("temperature").alias("temperature"))
    day = day.withColumn("temporada", temporada_of(season_of(F.col("date"))))
    return day.withColumn("pos", F.row_number().over(Window.partitionBy("temporada").orderBy("date")))


def boot_sql(replicates: int, seed: int = 123) -> str:
    """Replicates of the cold and warm daily series: same hashed starts, wrapped blocks."""
    return f"""{t.SALES},
dates AS (SELECT CAST(ts AS DATE) AS date, avg(energy) AS energy, avg(temperature) AS temperature FROM sales GROUP BY 1),
named AS (SELECT *, {t.season_sql('date')} AS season FROM dates),
series AS (
  SELECT {t.TEMPORADA} AS temporada, energy AS sx, temperature AS sy,
         row_number() OVER (PARTITION BY {t.TEMPORADA} ORDER BY date) - 1 AS slot FROM named),
sizes AS (SELECT temporada, count(*) AS n, greatest(1, CAST(round(count(*) / 4.0) AS BIGINT)) AS len FROM series GROUP BY 1),
points AS (
  SELECT temporada, replicate, pos, n, len, pos // len AS block FROM sizes,
    (SELECT unnest(range(1, {replicates + 1})) AS replicate), (SELECT unnest(range((SELECT max(n) FROM sizes))) AS pos) WHERE pos < n),
drawn AS (
  SELECT temporada, replicate, pos,
    (CAST('0x' || substr(md5('{seed}:' || replicate || ':' || block), 1, 8) AS BIGINT) % n + pos - block * len) % n AS slot
  FROM points),
boot AS (SELECT temporada, replicate, pos, sx AS x, sy AS y FROM drawn JOIN series USING (temporada, slot))"""


BOOT_K1 = (boot_sql(40) + ",\n" + lags_sql("boot", "temporada, replicate", 1, "spearman") + ",\n"
           + gcc_k1_sql("temporada, replicate"))


@query("bootstrap_replicates_k1", "temporada replicate", "gcc", sql=f"WITH {BOOT_K1} SELECT * FROM scores")
def bootstrap_replicates_k1(spark, d):
    return bs.block_bootstrap(_boot_series(spark, d), ["temporada"], "pos", "energy", "temperature", 40, 1)


@query("bootstrap_ci_k1", "temporada", "ci_low ci_high", sql=f"""
WITH {BOOT_K1}
SELECT temporada, quantile_cont(gcc, 0.025) AS ci_low, quantile_cont(gcc, 0.975) AS ci_high FROM scores GROUP BY 1""")
def bootstrap_ci_k1(spark, d):
    return bs.percentile_ci(bootstrap_replicates(spark, d, 40, 1), ["temporada"])


def bootstrap_replicates(spark, d, replicates, k):
    return materialise(
        bs.block_bootstrap(_boot_series(spark, d), ["temporada"], "pos", "energy", "temperature", replicates, k))


@query("bootstrap_ci_k7", "temporada", "ci_low ci_high", sql=f"""
WITH RECURSIVE {boot_sql(60)},
{lags_sql('boot', 'temporada, replicate', 7, 'spearman')},
{gcc_sql('temporada, replicate', 7)}
SELECT temporada, quantile_cont(gcc, 0.025) AS ci_low, quantile_cont(gcc, 0.975) AS ci_high FROM scores GROUP BY 1""")
def bootstrap_ci_k7(spark, d):
    return bs.percentile_ci(bootstrap_replicates(spark, d, 60, 7), ["temporada"])


@query("bootstrap_interval_full", "temporada", "ci_low ci_high")
def bootstrap_interval_full(spark, d):
    """The interval at its full 10,000 replicates; its parts are checked at 40 and 60 replicates above."""
    return plan.bootstrap_interval(_boot_series(spark, d).drop("pos"), "energy", "temperature", replicates=10_000, k=7)


@query("bootstrap_histogram", "bin n", "center density", sql=f"""
WITH {BOOT_K1},
b AS (SELECT CAST(ceil(gcc / 0.01 - 0.5 - 1e-8) AS BIGINT) AS bin, count(*) AS n FROM scores GROUP BY 1)
SELECT bin, n, bin * 0.01 AS center, n / (sum(n) OVER () * 0.01) AS density FROM b""")
def bootstrap_histogram(spark, d):
    return pf.histogram(bootstrap_replicates(spark, d, 40, 1), "gcc", 0.01)


# --- six pairs on the stationary population series ---------------------------------------------------

SEASONAL_PAIRS = [("energy", "temperature"), ("energy", "apparent")]
OVERALL_PAIRS = [("energy", "humidity"), ("temperature", "humidity"), ("apparent", "humidity"), ("apparent", "temperature")]
VARIABLES = ("energy", "temperature", "apparent", "humidity")


def _days_sql() -> str:
    still = ", ".join(f"{c} - lag({c}, 24) OVER w AS {c}" for c in VARIABLES)
    scaled = ", ".join(f"round(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 9) AS {c}" for c in VARIABLES)
    joined = "energy_2 " + " ".join(f"JOIN {c}_2 USING (meter, ts)" for c in VARIABLES[1:])
    return f"""{t.POPULATION_DAYS},
still AS (SELECT meter, ts, {still} FROM population WINDOW w AS (ORDER BY ts)),
""" + ",\n".join(_layers(c, "still") for c in VARIABLES) + f""",
scaled AS (SELECT CAST(ts AS DATE) AS date, {scaled}, {t.season_sql('ts')} AS season FROM {joined}),
daily AS (SELECT *, {t.TEMPORADA} AS temporada FROM scaled)"""


def pairs_boot_sql(replicates: int, seed: int = 123) -> str:
    long = [f"SELECT temporada, '{a}~{b}' AS pair, date, {a} AS sx, {b} AS sy FROM daily" for a, b in SEASONAL_PAIRS]
    long += [f"SELECT 'all', '{a}~{b}', date, {a}, {b} FROM daily" for a, b in OVERALL_PAIRS]
    return f"""{_days_sql()},
series AS (SELECT *, row_number() OVER (PARTITION BY temporada, pair ORDER BY date) - 1 AS slot FROM ({' UNION ALL '.join(long)})),
sizes AS (SELECT temporada, pair, count(*) AS n, greatest(1, CAST(round(count(*) / 4.0) AS BIGINT)) AS len FROM series GROUP BY 1, 2),
points AS (
  SELECT temporada, pair, replicate, pos, n, len, pos // len AS block FROM sizes,
    (SELECT unnest(range(1, {replicates + 1})) AS replicate), (SELECT unnest(range((SELECT max(n) FROM sizes))) AS pos) WHERE pos < n),
drawn AS (
  SELECT temporada, pair, replicate, pos,
    (CAST('0x' || substr(md5('{seed}:' || replicate || ':' || block), 1, 8) AS BIGINT) % n + pos - block * len) % n AS slot
  FROM points),
boot AS (SELECT temporada, pair, replicate, pos, sx AS x, sy AS y FROM drawn JOIN series USING (temporada, pair, slot))"""


def _pair_days(spark, d):
    return plan.daily_stationary(t.population(spark, d, "day"), "ts", "energy", "seasonal_difference", cols=VARIABLES)


@query("bootstrap_pairs_k7", "temporada pair replicate", "gcc", sql=f"""
WITH RECURSIVE {pairs_boot_sql(12)},
{lags_sql('boot', 'temporada, pair, replicate', 7, 'spearman')},
{gcc_sql('temporada, pair, replicate', 7)}
SELECT * FROM scores WHERE gcc IS NOT NULL""")
def bootstrap_pairs_k7(spark, d):
    """The first twelve replicates of ``bootstrap_pairs_full``, score by score: starts depend on seed and replicate only."""
    return plan.pair_samples(_pair_days(spark, d), SEASONAL_PAIRS, OVERALL_PAIRS, 12, 7).where("valid")


@query("bootstrap_pairs_full", "temporada pair n", "ci_low ci_high")
def bootstrap_pairs_full(spark, d):
    """Six pairs, 10,000 replicates each, on the stationary daily population series: two by season, four from all days."""
    return plan.pair_intervals(plan.pair_samples(_pair_days(spark, d), SEASONAL_PAIRS, OVERALL_PAIRS))


@query("bootstrap_pairs_full_mstl", "temporada pair n", "ci_low ci_high")
def bootstrap_pairs_full_mstl(spark, d):
    """The same from the hourly population series without its daily and weekly cycles."""
    days = plan.daily_stationary(t.population(spark, d), "ts", "energy", cols=VARIABLES)
    return plan.pair_intervals(plan.pair_samples(days, SEASONAL_PAIRS, OVERALL_PAIRS))
