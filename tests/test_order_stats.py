import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlab.operators.order_stats import (
    attach_stats, exact_fences, exact_quantiles, population_rank, row_numbers, value_positions)


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(5)
    hot = np.concatenate([rng.lognormal(size=4000), np.full(2000, 3.25)])
    cold = rng.normal(size=300)
    tiny = [7.0]
    return pd.DataFrame({
        "g": ["hot"] * len(hot) + ["cold"] * len(cold) + ["tiny"] + [None] * 50 + ["void"] * 5,
        "v": np.concatenate([hot, cold, tiny, rng.normal(size=50), [np.nan] * 5])})


def spark_frame(spark, pdf):
    rows = [(g, None if np.isnan(v) else float(v)) for g, v in zip(pdf["g"], pdf["v"])]
    return spark.createDataFrame(rows, "g string, v double").repartition(7)


@pytest.mark.parametrize("few", [16, 20000])
def test_quantiles_match_numpy(spark, skewed, few):
    probs = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.937, "f": 1.0}
    got = {r["g"]: r for r in exact_quantiles(spark_frame(spark, skewed), "v", probs, ["g"], few).collect()}
    for g, part in skewed.dropna(subset=["v"]).groupby("g", dropna=False):
        key = None if isinstance(g, float) else g
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(part["v"], p), abs=1e-12)
    assert "void" not in got and len(got) == 4


def test_quantiles_of_whole_table(spark, skewed):
    row = exact_quantiles(spark_frame(spark, skewed), "v", {"m": .5}).first()
    assert row["m"] == pytest.approx(np.nanmedian(skewed["v"]))


def test_fences_match_definition(spark, skewed):
    got = {r["g"]: r for r in exact_fences(spark_frame(spark, skewed), "v", ["g"]).collect()}
    for g, part in skewed.dropna(subset=["v"]).groupby("g", dropna=False):
        v = part["v"].to_numpy()
        q1, q3 = np.quantile(v, [.25, .75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        r = got[None if isinstance(g, float) else g]
        assert (r["n"], r["n_outliers"]) == (len(v), len(v) - len(inside))
        assert (r["lower_whisker"], r["upper_whisker"]) == (inside.min(), inside.max())


def test_positions_and_ranks(spark, skewed):
    df = spark_frame(spark, skewed)
    data = skewed.dropna(subset=["v"])
    for r in value_positions(df, "v", ["g"]).where("g = 'hot'").sample(0.05, 1).collect():
        v = data[data["g"] == "hot"]["v"]
        assert (r["below"], r["copies"], r["total"]) == ((v < r["value"]).sum(), (v == r["value"]).sum(), len(v))
    ranked = population_rank(df.where("g = 'hot' or g = 'void'"), "v", name="r").toPandas()
    assert len(ranked) == 6005 and ranked["r"].isna().sum() == 5
    hot = ranked.dropna(subset=["v"])
    assert (hot["r"] == hot["v"].rank(method="min", ascending=False)).all()


def test_attach_keeps_every_row_of_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    stats = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = attach_stats(rows, stats, ["k"])
    assert out.count() == 3000 and out.where("k = 'hot' and n = 1000").count() == 1000


@pytest.mark.parametrize("few", [40, 20000])
def test_quantiles_of_one_large_close_group(spark, few):
    """A group with nearly all rows in a narrow range, next to rows far away, and many copies of one value."""
    rng = np.random.default_rng(3)
    hot = np.concatenate([1e6 + rng.random(50000) * 1e-3, np.full(20000, 1e6 + 5e-4)])
    far = np.concatenate([rng.normal(size=5000) * 1e9, [-1e300, 1e300]])
    df = spark.createDataFrame(pd.DataFrame({"g": [1] * len(hot) + [2] * len(far), "v": np.concatenate([hot, far])})).repartition(5)
    probs = {"a": 0.001, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.9999}
    got = {r["g"]: r for r in exact_quantiles(df, "v", probs, ["g"], few).collect()}
    for g, v in ((1, hot), (2, far)):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(v, p), rel=1e-15, abs=1e-9)


def test_no_ordered_window_over_values(spark, skewed):
    df = exact_fences(spark_frame(spark, skewed), "v", ["g"])
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_row_numbers_need_no_local_table(spark):
    df = spark.range(100).select(F.pmod(F.col("id") * 37, F.lit(100)).alias("v")).repartition(7)
    out = row_numbers(df, ["v"], "n")
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()  # rows made in Python workers
    assert sorted(r[:] for r in out.collect()) == [(i, i) for i in range(100)]
    assert row_numbers(df.limit(0), ["v"], "n").collect() == []
