import statistics

import numpy as np
import pytest

from meterlab.operators import bootstrap as bs, dependence as dep


def plain_corr(a, b, method):
    ok = ~(np.isnan(a) | np.isnan(b))
    a, b = a[ok], b[ok]
    if method == "spearman":
        def rank(v):
            return np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
        a, b = rank(a), rank(b)
    if method == "kendall":
        pairs = [(np.sign(a[i] - a[j]), np.sign(b[i] - b[j])) for i in range(len(a)) for j in range(len(a))]
        s, t = np.array(pairs).T
        return (s * t).sum() / np.sqrt((s ** 2).sum() * (t ** 2).sum())
    return np.corrcoef(a, b)[0, 1]


def plain_gcc(x, y, k, method):
    """The definition cell by cell."""
    n, m = len(x), k + 1
    rx, ry, c = np.eye(m), np.eye(m), np.empty((m, m))
    for i in range(m):
        for j in range(m):
            h = abs(i - j)
            if h:
                rx[i, j] = plain_corr(x[:n - h], x[h:], method)
                ry[i, j] = plain_corr(y[:n - h], y[h:], method)
            c[i, j] = plain_corr(x[:n - h], y[h:], method) if i >= j else plain_corr(y[:n - h], x[h:], method)
    mod = ry - c @ np.linalg.inv(rx) @ c.T
    return 1 - (np.linalg.det(mod) / np.linalg.det(ry)) ** (1 / m)


@pytest.fixture(scope="module")
def pair():
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=120), 1)  # ties
    y = .5 * np.roll(x, 1) + rng.normal(size=120)
    y[[5, 40]] = np.nan
    return x, y


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
@pytest.mark.parametrize("k", [0, 1, 2, 8])
def test_value_matches_definition(pair, k, method):
    got, valid = dep.gcc_value(*pair, k, method)
    assert valid and got == pytest.approx(plain_gcc(*pair, k, method), abs=1e-10)


def long_frame(spark, x, y, key="a"):
    rows = [(key, i, float(u), None if np.isnan(v) else float(v)) for i, (u, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k string, pos int, x double, y double")


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_windowed_lags_and_closed_form(spark, pair, method):
    x, y = pair
    lags = dep.lag_correlations(long_frame(spark, x, y), ["k"], "pos", "x", "y", 2, method)
    got = {(r["kind"], r["lag"]): r["rho"] for r in lags.collect()}
    n = len(x)
    want = {("xy", 0): plain_corr(x, y, method)}
    for h in (1, 2):
        for kind, (u, v) in {"xx": (x, x), "yy": (y, y), "xy": (x, y), "yx": (y, x)}.items():
            want[kind, h] = plain_corr(u[:n - h], v[h:], method)
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
    for k in (0, 1):
        closed = dep.gcc_closed_form(lags, ["k"], k).first()["gcc"]
        arrays = dep.gcc(long_frame(spark, x, y), ["k"], "pos", "x", "y", k, method).first()["gcc"]
        assert closed == pytest.approx(plain_gcc(x, y, k, method)) == arrays


def seeded_normals(seed, n):
    """Mersenne Twister with inversion, as the published example draws its normals."""
    state = np.empty(625, dtype=np.uint64)
    value = seed
    for _ in range(50):
        value = (69069 * value + 1) % 2 ** 32
    for j in range(625):
        value = (69069 * value + 1) % 2 ** 32
        state[j] = value
    mt = np.random.MT19937()
    mt.state = {"bit_generator": "MT19937", "state": {"key": state[1:].astype(np.uint32), "pos": 624}}
    u = mt.random_raw(2 * n) * 2.3283064365386963e-10
    big = 134217728
    return np.array([statistics.NormalDist().inv_cdf((int(big * a) + b) / big) for a, b in zip(u[::2], u[1::2])])


def test_worked_example():
    z = seeded_normals(123, 1000)
    assert z[:3] == pytest.approx([-0.56047565, -0.23017749, 1.55870831])
    x = 3 + 2 * z
    y = .75 + x + x ** 2 + 3 * x ** 4
    assert dep.gcc_value(x, y, 1, "spearman")[0] == pytest.approx(.9864, abs=5e-5)
    assert dep.gcc_value(x, y, 1, "pearson")[0] == pytest.approx(.5357, abs=5e-5)


def test_degenerate_series(spark):
    t = np.arange(168)
    smooth = np.sin(2 * np.pi * t / 24)
    value, valid = dep.gcc_value(smooth, np.cos(2 * np.pi * t / 24), 24, "pearson")
    assert np.isnan(value) or not valid or 0 <= value <= 1
    assert dep.gcc_value(np.ones(50), smooth[:50], 1)[1] is False
    flat = long_frame(spark, np.ones(20), np.arange(20.0))
    assert dep.gcc(flat, ["k"], "pos", "x", "y", 1).first()["gcc"] is None
    assert dep.gcc_closed_form(dep.lag_correlations(flat, ["k"], "pos", "x", "y", 1), ["k"], 1).first()["gcc"] is None


def test_spearman_ignores_monotone_maps(pair):
    x, y = pair
    assert dep.gcc_value(x, y, 3, "spearman")[0] == pytest.approx(dep.gcc_value(np.exp(x), y ** 3, 3, "spearman")[0])


def test_ranking_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", .5), ("b", .9), ("c", .5), ("d", None), ("e", .1)], "k string, gcc double")
    got = {r["k"]: r["ranking"] for r in dep.rank_households(df).collect()}
    assert got == {"b": 1, "a": 2, "c": 2, "e": 4, "d": None}
    assert [r["k"] for r in dep.top_households(dep.rank_households(df), 1).collect()] == ["b"]


def test_bootstrap_is_reproducible_and_partition_free(spark, pair):
    x, y = pair
    df = long_frame(spark, x, y)
    one = bs.block_replicates(df, ["k"], "pos", "x", "y", 70, 30, seed=7)
    two = bs.block_replicates(df.repartition(9), ["k"], "pos", "x", "y", 70, 30, seed=7)
    a = {r["replicate"]: r for r in one.collect()}
    assert a == {r["replicate"]: r for r in two.collect()} and sorted(a) == list(range(1, 71))
    wrapped = np.concatenate([x, x])
    for r in list(a.values())[:5]:
        got = np.array(r["x"])
        assert len(got) == 120
        for b in range(4):
            block = got[30 * b:30 * b + 30]
            assert any((wrapped[s:s + 30] == block).all() for s in range(120))


def test_interval_is_ordered(spark, pair):
    samples = bs.block_bootstrap(long_frame(spark, *pair), ["k"], "pos", "x", "y", 50, 2)
    ci = bs.percentile_ci(samples, ["k"]).first()
    values = np.array([r["gcc"] for r in samples.collect()])
    assert ci["ci_low"] == pytest.approx(np.quantile(values, .025)) and ci["ci_low"] <= ci["ci_high"]


@pytest.mark.parametrize("gaps", [False, True])
def test_pairs_share_replicates_and_equal_the_single_bootstrap(spark, gaps):
    rng = np.random.default_rng(11)
    x = np.cumsum(rng.normal(size=90))
    cols = {"x": x, "y": np.roll(x, 2) + rng.normal(size=90), "z": rng.integers(0, 6, 90).astype(float)}
    if gaps:
        cols["x"][[0, 1, 40]] = cols["y"][[0, 1, 40]] = np.nan
        cols["z"][[5, 88]] = np.nan
    value = {c: [None if np.isnan(v) else float(v) for v in col] for c, col in cols.items()}
    rows = [(k, i, *(value[c][i] for c in "xyz")) for k in ("a", "b") for i in range(90) if k == "a" or i < 31]
    rows += [("short", i, float(i), float(-i), 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double, z double")
    pairs = [("x", "y"), ("z", "y"), ("x", "z")]
    got = {(r["k"], r["replicate"], r["pair"]): r for r in bs.block_bootstrap_pairs(df, ["k"], "t", pairs, 9, 3, chunk=4).collect()}
    assert len(got) == 3 * 9 * 3
    for u, v in pairs:
        for r in bs.block_bootstrap(df, ["k"], "t", u, v, 9, 3).collect():
            have = got[r["k"], r["replicate"], f"{u}~{v}"]
            assert have["valid"] == r["valid"]
            assert have["gcc"] == (None if r["gcc"] is None else pytest.approx(r["gcc"], abs=1e-9))
    assert all(r["gcc"] is None for key, r in got.items() if key[0] == "short")
