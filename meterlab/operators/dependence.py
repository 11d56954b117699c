"""Generalised cross-correlation of two series and the household ranking.

GCC compares the joint lag-correlation structure of x and y with that of each
alone: with Toeplitz matrices R_xx, R_yy of lag 0..k auto-correlations and C of
cross-correlations, GCC = 1 - (det(R_yy - C R_xx^-1 C') / det R_yy)^(1/(k+1)).
Only 4k+1 correlations differ among the 3(k+1)^2 cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlab.functions.calendar import temporada_of
from meterlab.functions.moments import joint_corr, zscore_over
from meterlab.operators.order_stats import population_rank

METHODS = ("pearson", "spearman", "kendall")


# --- typical week --------------------------------------------------------------

def typical_week(df: DataFrame, key: Sequence[str], ts: str, x: str, y: str, scale: bool = True,
                 digits: int | None = 9) -> DataFrame:
    """Mean of x and y per key and hour of the week, at most 168 rows per key.

    ``pos`` numbers the cells that exist (Monday 00:00 first); a missing cell
    shortens the series, as positions rather than slots define the lags.
    ``digits`` rounds the scaled values, so that means which are equal up to the
    order of summation are ties for the rank correlations in every run.
    """
    key = list(key)
    cells = (df.withColumns({"day_of_week": F.weekday(ts), "hour": F.hour(ts)})
             .groupBy(*key, "day_of_week", "hour").agg(F.avg(x).alias(x), F.avg(y).alias(y)))
    w = Window.partitionBy(*key)
    cells = cells.withColumn("pos", F.row_number().over(w.orderBy("day_of_week", "hour")).cast("bigint") - 1)
    if scale:
        scaled = {c: zscore_over(c, w) for c in (x, y)}
        cells = cells.withColumns({c: z if digits is None else F.round(z, digits) for c, z in scaled.items()})
    return cells.select(*key, "day_of_week", "hour", "pos", x, y)


# --- lag correlations as plain windows --------------------------------------------

def average_rank(value: str, group: Sequence[str]) -> Column:
    """Rank with ties sharing their mean, from one ordered window."""
    w = Window.partitionBy(*group).orderBy(value)
    upto = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (F.rank().over(w) + upto) / 2.0


def lag_correlations(df: DataFrame, key: Sequence[str], pos: str, x: str, y: str, k: int,
                     method: str = "pearson") -> DataFrame:
    """Correlations ``(key, kind, lag, rho)`` of all distinct lag pairs up to ``k``.

    kind   xx: x[t], x[t+lag]   yy: y[t], y[t+lag]
           xy: x[t], y[t+lag]   yx: y[t], x[t+lag]  (lag 0 appears once, as xy)

    Pairs with a NULL are dropped per lag; Spearman ranks are recomputed on the
    remaining pairs of that lag.  Everything runs on the key's partitioning:
    one shuffle, no join.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError("windowed lag correlations support pearson and spearman")
    key = list(key)
    w = Window.partitionBy(*key).orderBy(pos)
    lagged, pairs = {}, [("xy", 0, F.col(x), F.col(y))]
    for h in range(1, k + 1):
        xh, yh = f"__x{h}", f"__y{h}"
        lagged[xh], lagged[yh] = F.lead(x, h).over(w), F.lead(y, h).over(w)
        pairs += [("xx", h, F.col(x), F.col(xh)), ("yy", h, F.col(y), F.col(yh)),
                  ("xy", h, F.col(x), F.col(yh)), ("yx", h, F.col(y), F.col(xh))]
    wide = df.select(*key, pos, x, y).withColumns(lagged) if lagged else df.select(*key, pos, x, y)
    packed = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(h).alias("lag"),
                                a.cast("double").alias("a"), b.cast("double").alias("b"))
                       for kind, h, a, b in pairs])
    long = wide.select(*key, F.inline(packed))
    # The list of expected (kind, lag) groups survives even if no pair is complete.
    complete = F.col("a").isNotNull() & F.col("b").isNotNull()
    group = [*key, "kind", "lag"]
    if method == "spearman":
        ranks = {"a": average_rank("a", [*group, "__ok"]), "b": average_rank("b", [*group, "__ok"])}
        long = long.withColumn("__ok", complete).withColumns(ranks)
        complete = F.col("__ok")
    a, b = F.when(complete, F.col("a")), F.when(complete, F.col("b"))
    return long.groupBy(*group).agg(joint_corr(a, b).alias("rho"))


def gcc_closed_form(lags: DataFrame, key: Sequence[str], k: int) -> DataFrame:
    """GCC for k = 0 or 1 straight from the lag correlations, no Python."""
    def pick(kind: str, lag: int) -> Column:
        return F.max(F.when((F.col("kind") == kind) & (F.col("lag") == lag), F.col("rho")))

    key = list(key)
    if k == 0:
        return lags.groupBy(*key).agg(F.pow(pick("xy", 0), F.lit(2.0)).alias("gcc"))
    if k != 1:
        raise ValueError("closed form exists for k = 0 and k = 1 only")
    r = lags.groupBy(*key).agg(pick("xx", 1).alias("a"), pick("yy", 1).alias("b"), pick("xy", 0).alias("c0"),
                               pick("xy", 1).alias("c1"), pick("yx", 1).alias("cm"))
    a, b, c0, c1, cm = (F.col(n) for n in ("a", "b", "c0", "c1", "cm"))
    d = F.nullif(1 - a * a, F.lit(0.0))
    r = r.withColumns({
        "__m11": 1 - F.try_divide(c0 * c0 - 2 * a * c0 * cm + cm * cm, d),
        "__m22": 1 - F.try_divide(c1 * c1 - 2 * a * c1 * c0 + c0 * c0, d),
        "__m12": b - F.try_divide(c0 * c1 - a * (c0 * c0 + cm * c1) + cm * c0, d),
    })
    rest = F.col("__m11") * F.col("__m22") - F.col("__m12") * F.col("__m12")
    ratio = F.try_divide(rest, F.nullif(1 - b * b, F.lit(0.0)))
    return r.select(*key, F.when(ratio > 0, 1 - F.sqrt(ratio)).alias("gcc"))


# --- any k: one small array row per key, determinant in a vectorised function --------

def _ranks(v: np.ndarray) -> np.ndarray:
    _, where, count = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2.0)[where]


def _corr(a: np.ndarray, b: np.ndarray, method: str) -> float:
    ok = np.isfinite(a) & np.isfinite(b)
    a, b = a[ok], b[ok]
    if len(a) < 2:
        return np.nan
    if method == "kendall":
        sa, sb = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
        norm = np.sqrt((sa ** 2).sum() * (sb ** 2).sum())
        return float((sa * sb).sum() / norm) if norm > 0 else np.nan
    if method == "spearman":
        a, b = _ranks(a), _ranks(b)
    a, b = a - a.mean(), b - b.mean()
    norm = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / norm) if norm > 0 else np.nan


def _row_ranks(m: np.ndarray) -> np.ndarray:
    """Average ranks along each row; NaN sorts last and keeps a rank nobody looks at."""
    order = np.argsort(m, axis=1, kind="stable")
    v = np.take_along_axis(m, order, 1)
    at = np.broadcast_to(np.arange(m.shape[1]), m.shape)
    new = np.ones(m.shape, bool)
    new[:, 1:] = v[:, 1:] != v[:, :-1]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    stop = np.ones(m.shape, bool)
    stop[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(stop, at, m.shape[1])[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(m.shape)
    np.put_along_axis(out, order, (first + last) / 2.0, 1)
    return out


def _row_corr(a: np.ndarray, b: np.ndarray, method: str) -> np.ndarray:
    """Correlation of each row of ``a`` with that of ``b`` over the places where both are finite."""
    ok = np.isfinite(a) & np.isfinite(b)
    n = ok.sum(axis=1)
    a, b = np.where(ok, a, np.nan), np.where(ok, b, np.nan)
    if method == "spearman":
        a, b = _row_ranks(a), _row_ranks(b)
    count = np.maximum(n, 1)[:, None]
    a, b = (np.where(ok, v - np.where(ok, v, 0).sum(axis=1, keepdims=True) / count, 0.0) for v in (a, b))
    norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((n >= 2) & (norm > 0), (a * b).sum(axis=1) / norm, np.nan)


def _array_lags(x: np.ndarray, y: np.ndarray, k: int, method: str) -> tuple[np.ndarray, ...]:
    """Correlations xx, yy, xy, yx at lags 0..k, all lags as one array operation (kendall: one by one)."""
    n, lag = len(x), range(k + 1)
    sides = ((x, x), (y, y), (x, y), (y, x))
    if method == "kendall":
        return tuple(np.array([_corr(u[:n - h], v[h:], method) for h in lag]) for u, v in sides)
    a, b = (np.full((4 * (k + 1), n), np.nan) for _ in range(2))
    for i, (u, v) in enumerate(sides):
        for h in lag:
            a[i * (k + 1) + h, :n - h], b[i * (k + 1) + h, :n - h] = u[:n - h], v[h:]
    return tuple(_row_corr(a, b, method).reshape(4, k + 1))


def _definite(m: np.ndarray) -> bool:
    try:
        np.linalg.cholesky((m + m.T) / 2)
    except np.linalg.LinAlgError:
        return False
    return True


def gcc_value(x: np.ndarray, y: np.ndarray, k: int, method: str = "pearson") -> tuple[float, bool]:
    """GCC of two aligned series and whether their correlation matrices are positive definite."""
    if len(x) <= k + 1:
        return np.nan, False
    return gcc_of_lags(*_array_lags(x, y, k, method))


def gcc_of_lags(xx: np.ndarray, yy: np.ndarray, xy: np.ndarray, yx: np.ndarray) -> tuple[float, bool]:
    """GCC from the correlations at lags 0..k, and whether their matrices are positive definite."""
    k = len(xx) - 1
    lag = np.arange(k + 1)
    offset = lag[:, None] - lag
    r_xx, r_yy = xx[abs(offset)], yy[abs(offset)]
    c = np.where(offset >= 0, xy[abs(offset)], yx[abs(offset)])
    np.fill_diagonal(r_xx, 1.0)
    np.fill_diagonal(r_yy, 1.0)
    if not (np.isfinite(r_xx).all() and np.isfinite(r_yy).all() and np.isfinite(c).all()):
        return np.nan, False
    try:
        rest = r_yy - c @ np.linalg.solve(r_xx, c.T)
    except np.linalg.LinAlgError:
        return np.nan, False
    (s1, l1), (s0, l0) = np.linalg.slogdet(rest), np.linalg.slogdet(r_yy)
    if s0 == 0 or s1 * s0 <= 0:
        return np.nan, False
    return float(-np.expm1((l1 - l0) / (k + 1))), all(map(_definite, (r_xx, r_yy, rest)))


def _gcc_udf(k: int, method: str):
    schema = T.StructType([T.StructField("gcc", T.DoubleType()), T.StructField("valid", T.BooleanType())])

    def score(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        got = [gcc_value(np.asarray(x, dtype=float), np.asarray(y, dtype=float), k, method)
               for x, y in zip(xs, ys, strict=True)]
        return pd.DataFrame({"gcc": [None if np.isnan(g) else g for g, _ in got], "valid": [v for _, v in got]})

    # Marked so that a later filter on the result neither repeats nor moves the evaluation.
    return F.pandas_udf(score, schema).asNondeterministic()


def series_arrays(df: DataFrame, key: Sequence[str], pos: str, x: str, y: str) -> DataFrame:
    """One row per key with the aligned series as arrays ``x`` and ``y`` in ``pos`` order.

    For bounded series only (a typical week has at most 168 cells).
    """
    cells = F.array_sort(F.collect_list(F.struct(
        F.col(pos).alias("p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    return (df.groupBy(*key).agg(cells.alias("__s"))
            .select(*key, F.col("__s.x").alias("x"), F.col("__s.y").alias("y")))


def gcc_of_arrays(arrays: DataFrame, k: int, method: str = "spearman") -> DataFrame:
    """Replace array columns ``x`` and ``y`` by ``gcc`` and ``valid``."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    keep = [c for c in arrays.columns if c not in ("x", "y")]
    scored = arrays.withColumn("__g", _gcc_udf(k, method)("x", "y"))
    return scored.select(*keep, F.col("__g.gcc").alias("gcc"), F.col("__g.valid").alias("valid"))


def gcc(df: DataFrame, key: Sequence[str], pos: str, x: str, y: str, k: int, method: str = "spearman") -> DataFrame:
    """GCC per key for any number of lags: ``(key, gcc, valid)``."""
    return gcc_of_arrays(series_arrays(df, key, pos, x, y), k, method)


def gcc_by_household(df: DataFrame, key: str, ts: str, x: str, y: str, k: int = 24, method: str = "spearman",
                     by_seasons: bool = True, season: str = "season") -> DataFrame:
    """GCC of the typical weeks; cold and warm season are one more grouping key."""
    keys = [key]
    if by_seasons:
        df = df.withColumn("temporada", temporada_of(F.col(season)))
        keys.append("temporada")
    week = typical_week(df, keys, ts, x, y)
    return gcc(week, keys, "pos", x, y, k, method)


def run_pairs(df: DataFrame, key: Sequence[str], pos: str, pairs: Sequence[tuple[str, str]], k: int,
              method: str = "spearman") -> DataFrame:
    """GCC of several variable pairs in one job, ``pair`` as an extra key."""
    packed = F.array(*[F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(a).cast("double").alias("x"),
                                F.col(b).cast("double").alias("y")) for a, b in pairs])
    long = df.select(*key, pos, F.inline(packed))
    return gcc(long, [*key, "pair"], pos, "x", "y", k, method)


# --- ranking ---------------------------------------------------------------------------

def rank_households(scores: DataFrame, by: Sequence[str] = (), value: str = "gcc",
                    name: str = "ranking") -> DataFrame:
    """Rank 1 = strongest dependence; ties share the smallest rank, NULL stays NULL."""
    return population_rank(scores, value, by, name, descending=True)


def enrich_ranking(ranking: DataFrame, households: DataFrame, key: str, id_col: str) -> DataFrame:
    """Add household attributes to a ranking."""
    return ranking.join(households.withColumnRenamed(id_col, key), key, "left")


def top_households(ranking: DataFrame, n: int, name: str = "ranking") -> DataFrame:
    """The first ``n`` households of a ranking."""
    return ranking.where(F.col(name).isNotNull()).orderBy(name).limit(n)
