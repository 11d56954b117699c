import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlab.operators import profiles as pf


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(400, 2))
    return np.column_stack([base[:, 0], 2 * base[:, 0] + .3 * base[:, 1], base[:, 1], rng.normal(size=400)])


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double, d double")


def test_components_match_eigenvectors(data, df):
    values, vectors = np.linalg.eigh(np.corrcoef(data.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    got = pf.pca(df, list("abcd"), 3).toPandas()
    for k in range(3):
        part = got[got.component == k + 1].set_index("variable").loc[list("abcd")]
        assert part["explained"].iloc[0] == pytest.approx(values[k] / 4)
        assert abs(part["loading"].to_numpy() @ vectors[:, k]) == pytest.approx(1)


def test_correlations(data, df):
    got = {(r["a"], r["b"]): r["rho"] for r in pf.correlation_matrix(df.withColumn("k", F.lit(1.0)), list("abck")).collect()}
    want = np.corrcoef(data[:, :3].T)
    assert all(got["abc"[i], "abc"[j]] == pytest.approx(want[i, j]) for i in range(3) for j in range(3))
    assert got["a", "k"] is None


def test_density_integrates_to_one_and_matches_kernel_sum(data, df):
    x = data[:, 0]
    h = .9 * min(x.std(ddof=1), np.subtract(*np.quantile(x, [.75, .25])) / 1.34) * len(x) ** -.2
    got = pf.kernel_density(df, "a", points=512).toPandas().sort_values("point")
    exact = np.exp(-.5 * ((got["x"].to_numpy()[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.abs(got["density"] - exact).max() < 1e-3 * exact.max()


def test_constant_columns_do_not_fail(spark):
    flat = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert pf.kernel_density(flat, "v", points=16).count() > 0
    assert [tuple(r) for r in pf.histogram_bins(flat, "v").select("bin", "n").collect()] == [(0, 2)]
    box = pf.box_stats(flat, "v").first()
    assert (box["n"], box["q1"], box["lower_whisker"], box["n_outliers"]) == (2, 2.0, 2.0, 0)
    assert pf.six_number_summary(flat, "v").first()["n_null"] == 1


def test_histogram_is_closed_on_the_right(spark):
    df = spark.createDataFrame([(v,) for v in (-.5, .5, .500001, 1.5, 2.0)], "v double")
    got = {r["bin"]: r["n"] for r in pf.histogram(df, "v", 1.0).collect()}
    assert got == {-1: 1, 0: 1, 1: 2, 2: 1}


def test_trend_recovers_a_line(spark):
    df = spark.range(500).selectExpr("id / 100.0D AS x", "3 - 2 * id / 100.0D AS y")
    fit = pf.local_trend(df, "x", "y").toPandas()
    assert len(fit) == 80 and np.allclose(fit["fitted"], 3 - 2 * fit["x"], atol=1e-8)


def test_mode_prefers_first_seen(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 4), ("k", "b", 3)], "k string, c string, t int")
    assert pf.mode_by(df, ["k"], "c", "t").first()["c"] == "b"


def test_strict_mean_and_overview(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("b", None, None)], "k string, v double, w double")
    got = {r["k"]: r["v"] for r in pf.mean_by(df, ["k"], ["v"]).collect()}
    assert got == {"a": 2.0, "b": None}
    row = pf.table_overview(df).first().asDict()
    assert row == {"n_rows": 3, "n_columns": 3, "discrete_columns": 1, "continuous_columns": 2,
                   "all_missing_columns": 1, "complete_rows": 0, "missing_cells": 4}
