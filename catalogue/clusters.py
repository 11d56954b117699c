"""Quantile-autocovariance features, clustering, household flags, association."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import tables as t
from catalogue.preparation import CLEAN, _cleaned
from catalogue.registry import query
from catalogue.stationary import DIFF, LAYER1, LAYER2, _user_prepared
from meterlab.operators import association as assoc, cluster as cl
from meterlab.operators.stationary import heavily_imputed
from meterlab.sources.stages import materialise

TAUS = (.1, .5, .9)
NAMES = [cl.feature_name(a, b, 1) for a in TAUS for b in TAUS]

QAF = t.USER_HOURLY + """,
marked AS (
  SELECT meter, ts, energy, lead(energy) OVER (PARTITION BY meter ORDER BY ts) AS ahead,
         count(*) OVER (PARTITION BY meter) AS n,
""" + ",\n".join(f"         quantile_cont(energy, {a}) OVER (PARTITION BY meter) AS q{round(a * 100)}" for a in TAUS) + """
  FROM user_hourly),
qaf AS (
  SELECT meter,
""" + ",\n".join(
    f"    sum(CASE WHEN energy <= q{round(a * 100)} AND ahead <= q{round(b * 100)} THEN 1 ELSE 0 END) / nullif(any_value(n) - 1, 0) - {a} * {b}"
    f" AS {cl.feature_name(a, b, 1)}" for a in TAUS for b in TAUS) + """
  FROM marked GROUP BY meter)"""


def _features(spark, d):
    return cl.qaf_features(t.user_hourly(spark, d), "meter", "ts", "energy", TAUS)


@query("qaf_features", "meter", " ".join(NAMES), sql=f"WITH {QAF} SELECT * FROM qaf")
def qaf_features(spark, d):
    return _features(spark, d)


@query("pairs_within", "i j", "distance", sql=f"""
WITH {QAF},
pts AS (SELECT meter, [{', '.join(NAMES)}] AS point FROM qaf WHERE {' AND '.join(n + ' IS NOT NULL' for n in NAMES)})
SELECT a.meter AS i, b.meter AS j, list_distance(a.point, b.point) AS distance
FROM pts a JOIN pts b ON a.meter < b.meter WHERE list_distance(a.point, b.point) <= 0.0301""")
def pairs_within(spark, d):
    return cl.pairs_within(cl.as_vectors(_features(spark, d), "meter", NAMES), "meter", 0.0301)


# Clusterings are checked in tests/test_cluster.py against a plain greedy merge.

@query("ward_clusters", "meter cluster")
def ward_clusters(spark, d):
    return cl.ward_clusters(materialise(cl.as_vectors(_features(spark, d), "meter", NAMES)), "meter", 0.5)


@query("ward_clusters_rounds", "meter cluster")
def ward_clusters_rounds(spark, d):
    """The same cut with rounds that begin at a larger merge height."""
    return cl.ward_clusters(materialise(cl.as_vectors(_features(spark, d), "meter", NAMES)), "meter", 0.5, start=0.03)


@query("cluster_twice", "meter cluster")
def cluster_twice(spark, d):
    return cl.cluster_twice(t.user_hourly(spark, d), "meter", "ts", "energy", min_size=5)[0]


# What a Ward partition must fulfil, recomputed from points and labels; the cut itself has no SQL twin.
CERTIFICATE = "n missing misnamed too_close too_loose split_copies"
SOUND = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in CERTIFICATE.split()[1:])
COMPLETE = " AND ".join(f"{n} IS NOT NULL" for n in NAMES)


@query("ward_certificate", CERTIFICATE, sql=f"WITH {QAF} SELECT count(*) AS n, {SOUND} FROM qaf WHERE {COMPLETE}")
def ward_certificate(spark, d):
    points = materialise(cl.as_vectors(_features(spark, d), "meter", NAMES))
    return cl.ward_certificate(points, "meter", cl.ward_clusters(points, "meter", 0.5), 0.5)


@query("cluster_twice_certificate", "second " + CERTIFICATE, sql=f"""
WITH {QAF}, pts AS (SELECT meter FROM qaf WHERE {COMPLETE})
SELECT false AS second, count(*) AS n, {SOUND} FROM pts UNION ALL SELECT true, count(*), {SOUND} FROM pts""")
def cluster_twice_certificate(spark, d):
    """Both passes: all households at 0.7, those of large clusters at 0.5; ``n`` of the second counts the dropped ones too."""
    points = materialise(cl.as_vectors(_features(spark, d), "meter", NAMES))
    first = cl.ward_clusters(points, "meter", 0.7)
    names = materialise(cl.small_clusters(first, "meter", "cluster", 5))
    dropped = names.where(F.col("label") == cl.OUTLIER).select("meter")
    kept = materialise(points.join(dropped, "meter", "left_anti"))
    one = cl.ward_certificate(points, "meter", first, 0.7).withColumn("second", F.lit(False))
    two = cl.ward_certificate(kept, "meter", cl.ward_clusters(kept, "meter", 0.5), 0.5)
    two = two.withColumn("n", F.col("n") + dropped.agg(F.count(F.lit(1))).scalar())
    return one.unionByName(two.withColumn("second", F.lit(True)))


@query("small_clusters", "id acorn label", sql=f"""
WITH {t.HOUSEHOLDS},
sizes AS (SELECT acorn, count(*) AS n, min(id) AS first FROM households GROUP BY acorn),
names AS (SELECT acorn, CAST(row_number() OVER (ORDER BY first) AS VARCHAR) AS name FROM sizes WHERE n >= 60)
SELECT id, acorn, coalesce(name, 'outlier') AS label FROM households LEFT JOIN names USING (acorn)""")
def small_clusters(spark, d):
    return cl.small_clusters(t.households(spark, d), "id", "acorn", 60)


SILHOUETTE = """pts AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS point FROM embeddings),
sums AS (
  SELECT a.vec_id, a.label AS mine, b.label AS other, sum(list_distance(a.point, b.point)) AS s, count(*) AS n
  FROM pts a, pts b GROUP BY 1, 2, 3),
ab AS (
  SELECT vec_id, mine AS label, max(CASE WHEN other = mine THEN n END) AS size,
         max(CASE WHEN other = mine AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN other <> mine THEN s / n END) AS b
  FROM sums GROUP BY 1, 2),
silhouettes AS (
  SELECT vec_id, label, CASE WHEN size = 1 THEN 0 ELSE (b - a) / nullif(greatest(a, b), 0) END AS silhouette FROM ab)"""


def _silhouette(spark, d):
    pts = t.table(spark, d, "embeddings").select(
        "vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("point"))
    return cl.silhouette(pts, "vec_id", "label")


@query("silhouette", "vec_id label", "silhouette", sql=f"WITH {SILHOUETTE} SELECT vec_id, CAST(label AS BIGINT) AS label, silhouette FROM silhouettes")
def silhouette(spark, d):
    return _silhouette(spark, d)


@query("mean_silhouette", "one", "mean_silhouette", sql=f"WITH {SILHOUETTE} SELECT 1 AS one, avg(silhouette) AS mean_silhouette FROM silhouettes")
def mean_silhouette(spark, d):
    return cl.mean_silhouette(_silhouette(spark, d)).withColumn("one", F.lit(1))


FLAGS = CLEAN + ",\n" + t.HOUSEHOLDS + ",\n" + t.USER_HOURLY + ",\n" + DIFF.format(src="user_hourly") + ",\n" + LAYER1 + ",\n" + LAYER2 + """,
shares AS (
  SELECT meter, avg(CASE WHEN mark_one OR mark_two THEN 1.0 ELSE 0.0 END) AS pct_imputed FROM two GROUP BY meter),
heavy AS (SELECT meter FROM shares WHERE pct_imputed > (SELECT quantile_cont(pct_imputed, 0.9) FROM shares)),
sizes AS (SELECT acorn, count(*) AS n, min(id) AS first FROM households GROUP BY acorn),
names AS (SELECT acorn, CAST(row_number() OVER (ORDER BY first) AS VARCHAR) AS name FROM sizes WHERE n >= 60),
labels AS (SELECT id, coalesce(name, 'outlier') AS cluster FROM households LEFT JOIN names USING (acorn)),
flags AS (
  SELECT h.*, cluster, h.id IN (SELECT id_removed FROM removed WHERE motive = 'Outlier Excess') AS outlier_datacleaning,
         h.id IN (SELECT id_removed FROM removed WHERE motive = 'NA excess') AS NA_datacleaning,
         h.id IN (SELECT meter FROM heavy) AS outlier_preprocessing, cluster = 'outlier' AS outlier_clustering
  FROM households h JOIN labels USING (id))"""


@query("household_flags", "id acorn_grouped outlier_datacleaning NA_datacleaning outlier_preprocessing outlier_clustering remove cluster", sql=f"""
WITH {FLAGS}
SELECT id, acorn_grouped, outlier_datacleaning, NA_datacleaning, outlier_preprocessing, outlier_clustering, cluster,
       outlier_datacleaning OR NA_datacleaning OR outlier_preprocessing OR outlier_clustering
         OR acorn_grouped IN ('FURNITURE') AS remove
FROM flags""")
def household_flags(spark, d):
    hh = t.households(spark, d)
    labels = cl.small_clusters(hh, "id", "acorn", 60).select("id", F.col("label").alias("cluster"))
    heavy = heavily_imputed(_user_prepared(spark, d), "meter").withColumnRenamed("meter", "id")
    return cl.household_flags(hh, "id", _cleaned(spark, d).removed, heavy,
                              labels.where(F.col("cluster") == cl.OUTLIER), labels, "acorn_grouped", ("FURNITURE",))


# --- association ------------------------------------------------------------------------------

def table_sql(src: str, a: str, b: str) -> str:
    return f"""cells AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
margins AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS c FROM cells),
test AS (
  SELECT CAST(sum(n) AS BIGINT) AS n, count(DISTINCT a) AS n_rows, count(DISTINCT b) AS n_cols,
         sum(n) * (sum(n * n / (r * c)) - 1) AS chi2 FROM margins)"""


SEGMENT = t.HOUSEHOLDS + ",\n" + table_sql("households", "acorn_grouped", "acorn")


@query("contingency", "acorn_grouped acorn n row_total col_total", sql=f"""
WITH {SEGMENT}
SELECT a AS acorn_grouped, b AS acorn, n, CAST(r AS BIGINT) AS row_total, CAST(c AS BIGINT) AS col_total FROM margins""")
def contingency(spark, d):
    return assoc.contingency(t.households(spark, d), "acorn_grouped", "acorn")


@query("chi_square", "n n_rows n_cols dof", "chi2", sql=f"""
WITH {SEGMENT} SELECT n, n_rows, n_cols, (n_rows - 1) * (n_cols - 1) AS dof, chi2 FROM test""")
def chi_square(spark, d):
    return assoc.chi_square(t.households(spark, d), "acorn_grouped", "acorn")


@query("chi_square_two_by_two", "n n_rows n_cols dof", "chi2", sql=f"""
WITH {t.HOUSEHOLDS},
flat AS (SELECT tariff, acorn_grouped = 'BUILDING' AS building FROM households),
counts AS (
  SELECT count(*) AS n, count(*) FILTER (tariff = 'Std' AND building) AS a, count(*) FILTER (tariff = 'Std' AND NOT building) AS b,
         count(*) FILTER (tariff = 'ToU' AND building) AS c, count(*) FILTER (tariff = 'ToU' AND NOT building) AS d FROM flat)
SELECT n, CAST(2 AS BIGINT) AS n_rows, CAST(2 AS BIGINT) AS n_cols, CAST(1 AS BIGINT) AS dof,
       n * pow(abs(a * d - b * c) - least(abs(a * d - b * c), n / 2.0), 2)
         / (CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d)) AS chi2
FROM counts""")
def chi_square_two_by_two(spark, d):
    flat = t.households(spark, d).withColumn("building", F.col("acorn_grouped") == "BUILDING")
    return assoc.chi_square(flat, "tariff", "building")


@query("chi_square_p_value", "dof", "chi2 p_value", sql=f"""
WITH {SEGMENT},
half AS (SELECT chi2, CAST((n_rows - 1) * (n_cols - 1) AS BIGINT) AS dof, chi2 / 2 AS h FROM test)
SELECT dof, chi2, CASE WHEN dof % 2 = 0 THEN (SELECT sum(exp(i * ln(h) - h - lgamma(i + 1))) FROM range(dof // 2) r(i)) END AS p_value
FROM half""")
def chi_square_p_value(spark, d):
    return assoc.chi_square_p_value(t.households(spark, d), "acorn_grouped", "acorn")


@query("cramers_v", "n", "cramers_v", sql=f"""
WITH {SEGMENT},
shrunk AS (
  SELECT n, greatest(0, chi2 / n - (n_rows - 1.0) * (n_cols - 1.0) / (n - 1)) AS phi2,
         n_rows - pow(n_rows - 1, 2) / (n - 1) AS r, n_cols - pow(n_cols - 1, 2) / (n - 1) AS c FROM test)
SELECT n, sqrt(phi2 / least(r - 1, c - 1)) AS cramers_v FROM shrunk""")
def cramers_v(spark, d):
    return assoc.cramers_v(t.households(spark, d), "acorn_grouped", "acorn")


@query("cramers_v_flags", "n", "cramers_v", sql=f"""
WITH {table_sql('lineitem', 'l_returnflag', 'l_linestatus')},
shrunk AS (
  SELECT n, greatest(0, chi2 / n - (n_rows - 1.0) * (n_cols - 1.0) / (n - 1)) AS phi2,
         n_rows - pow(n_rows - 1, 2) / (n - 1) AS r, n_cols - pow(n_cols - 1, 2) / (n - 1) AS c FROM test)
SELECT n, sqrt(phi2 / least(r - 1, c - 1)) AS cramers_v FROM shrunk""")
def cramers_v_flags(spark, d):
    return assoc.cramers_v(t.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
