import numpy as np
import pytest

from meterlab.operators import stationary as st
from meterlab.operators.seasonal import _smooth, decompose, seasonal_trend


def series(n=24 * 7 * 8, seed=3):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return (2 + .002 * t + np.sin(2 * np.pi * t / 24) + .7 * np.cos(2 * np.pi * t / 168) + rng.normal(scale=.2, size=n))


def plain_loess(y, window, degree, at):
    """Textbook local regression at one (possibly outside) position."""
    n = len(y)
    order = sorted(range(n), key=lambda j: (abs(j - at), j))[:min(window, n)]
    lo = min(max(int(np.floor(at)) - (min(window, n) - 1) // 2, 0), n - min(window, n))
    idx = np.arange(lo, lo + min(window, n)) if window % 2 else np.sort(order)
    h = max(at - idx[0], idx[-1] - at) + (max(window - n, 0)) // 2
    r = np.abs(idx - at) / h
    w = np.where(r <= .001, 1, np.where(r <= .999, (1 - r ** 3) ** 3, 0))
    if degree == 0:
        return (w * y[idx]).sum() / w.sum()
    coef = np.linalg.lstsq(np.sqrt(w)[:, None] * np.stack([np.ones(len(idx)), idx], 1), np.sqrt(w) * y[idx], rcond=None)[0]
    return coef[0] + coef[1] * at


@pytest.mark.parametrize("window,degree", [(7, 0), (7, 1), (25, 1), (61, 1)])
def test_smoother_matches_brute_force(window, degree):
    y = np.random.default_rng(0).normal(size=40)
    fast = _smooth(y[None, :], window, degree, 1, pad=1)[0]
    slow = [plain_loess(y, window, degree, at) for at in range(-1, 41)]
    assert np.allclose(fast, slow)


def test_jump_interpolates_linearly():
    y = np.random.default_rng(1).normal(size=50)
    full, jumped = _smooth(y[None, :], 11, 1, 1)[0], _smooth(y[None, :], 11, 1, 5)[0]
    assert np.allclose(jumped[::5], full[::5]) and jumped[-1] == pytest.approx(full[-1])
    assert jumped[2] == pytest.approx(.6 * full[0] + .4 * full[5])


@pytest.mark.parametrize("robust", [False, True])
def test_parts_add_up_and_recover_signal(robust):
    x = series()
    parts = decompose(x, (24, 168), robust=robust)
    assert np.allclose(parts.trend + sum(parts.seasonal.values()) + parts.remainder, x)
    t = np.arange(len(x))
    assert np.corrcoef(parts.seasonal[24], np.sin(2 * np.pi * t / 24))[0, 1] > .97
    by_hour = parts.remainder.reshape(-1, 24).mean(axis=0)
    assert np.abs(by_hour).max() < .1


def test_pure_season_and_line_is_exact():
    t = np.arange(24 * 20)
    season, trend = seasonal_trend(3 + .01 * t + np.sin(2 * np.pi * t / 24), 24, 11)
    assert np.abs(3 + .01 * t + np.sin(2 * np.pi * t / 24) - season - trend).max() < .02


def test_short_and_missing_series():
    assert np.isnan(decompose(np.full(5, np.nan), (24,)).remainder).all()
    x = series(60)
    x[7] = np.nan
    parts = decompose(x, (24, 168))
    assert (parts.seasonal[168] == 0).all() and np.isfinite(parts.remainder).all()
    assert np.isfinite(decompose(np.array([1.0]), (24,)).trend).all()


def test_grouped_job_equals_helper(spark):
    x = series(24 * 21)
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, float(v)) for i, v in enumerate(x[::-1])]
    df = spark.createDataFrame(rows, "k string, i int, v double").selectExpr(
        "k", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, i) AS ts", "v").repartition(5)
    got = st.mstl_components(df, ["k"], "ts", "v", (24, 168), log1p=True).toPandas().sort_values(["k", "ts"])
    want = decompose(np.log1p(x), (24, 168))
    assert np.allclose(got[got.k == "a"]["remainder"], want.remainder)
    out = st.stationarise(df, ["k"], "ts", "v", periods={"v": (24, 168)}, impute=False).toPandas().sort_values(["k", "ts"])
    assert np.allclose(out[out.k == "a"]["v"], want.remainder) and out["pct_imputed"].isna().all()


def test_imputation_share_and_validation(spark):
    rows = [("a", i, float((i * 37) % 11) if i % 97 else 500.0) for i in range(24 * 40)]
    df = spark.createDataFrame(rows, "k string, i int, v double").selectExpr(
        "k", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, i) AS ts", "v")
    out = st.stationarise(df, ["k"], "ts", "v", transformation="seasonal_difference", standardise=True)
    row = out.selectExpr("avg(v) m", "stddev_samp(v) s", "max(pct_imputed) p").first()
    assert abs(row["m"]) < 1e-9 and row["s"] == pytest.approx(1) and 0 < row["p"] < 1
    with pytest.raises(ValueError):
        st.stationarise(df, ["k"], "ts", "v", transformation="other")
    with pytest.raises(ValueError):
        st.single_timestamp(df.withColumn("ts2", df.ts))
    assert st.single_timestamp(df) == "ts"
    assert st.numeric_columns(df.selectExpr("*", "1 AS hour")) == ["v"]
