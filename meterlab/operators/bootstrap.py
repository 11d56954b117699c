"""Fixed-length block bootstrap of the GCC of one (or a few) daily series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlab.operators.dependence import gcc_of_arrays, gcc_of_lags, series_arrays
from meterlab.operators.order_stats import exact_quantiles


def block_draw(seed: int, replicate: Column, block: Column, n: Column) -> Column:
    """Start of a block, uniform on 0..n-1, a pure function of its arguments.

    Hash based, so results do not depend on partitioning, retries or order.
    """
    text = F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), block.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), n.cast("bigint"))


def block_replicates(df: DataFrame, key: Sequence[str], pos: str, x: str, y: str, replicates: int,
                     block_len: int | None = None, seed: int = 123) -> DataFrame:
    """Resampled series, one row ``(key, replicate, x, y)`` with arrays per replicate.

    The series is a daily one: its length is bounded by the calendar, whatever
    the size of the readings behind it.  A replicate is built inside its own row
    with array functions, so there is no join and no shuffle of resampled points.
    Blocks start anywhere and wrap around; the default length is a quarter of
    the series.
    """
    key = list(key)
    series = series_arrays(df, key, pos, x, y).withColumn("__n", F.size("x"))
    length = F.lit(block_len) if block_len else F.greatest(F.lit(1), F.round(F.col("__n") / 4.0).cast("int"))
    series = series.withColumns({"__len": length})
    # Group the replicate numbers so that long arrays are copied a few times, not per replicate.
    chunk = 64
    chunks = F.sequence(F.lit(0), F.lit((replicates - 1) // chunk))
    spread = (series.withColumn("__chunk", F.explode(chunks))
              .repartition(*key, "__chunk"))
    numbered = spread.withColumn("replicate", F.explode(F.sequence(
        (F.col("__chunk") * chunk + 1).cast("bigint"),
        F.least((F.col("__chunk") + 1) * chunk, F.lit(replicates)).cast("bigint"))))
    n, size = F.col("__n"), F.col("__len")
    blocks = F.sequence(F.lit(0), (F.ceil(n / size) - 1).cast("int"))

    def positions(block: Column) -> Column:
        start = block_draw(seed, F.col("replicate"), block, n)
        return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.pmod(start + i, n.cast("bigint")).cast("int"))

    taken = numbered.withColumn("__at", F.slice(F.flatten(F.transform(blocks, positions)), 1, n))
    return taken.select(
        *key, "replicate",
        F.transform("__at", lambda i: F.get(F.col("x"), i)).alias("x"),
        F.transform("__at", lambda i: F.get(F.col("y"), i)).alias("y"))


def block_bootstrap(df: DataFrame, key: Sequence[str], pos: str, x: str, y: str, replicates: int = 10000,
                    k: int = 7, block_len: int | None = None, seed: int = 123,
                    method: str = "spearman") -> DataFrame:
    """GCC of every replicate: ``(key, replicate, gcc, valid)``."""
    drawn = block_replicates(df, key, pos, x, y, replicates, block_len, seed)
    return gcc_of_arrays(drawn, k, method)


# --- several pairs on the same replicates -----------------------------------------------------

class _Series:
    """Variables of one key as dense codes (-1: unknown), so ranks within any subset come from counts instead of a sort."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.n = len(next(iter(columns.values())))
        self.codes, self.levels, self.mask_of, masks = {}, {}, {}, {}
        for name, v in columns.items():
            known = np.isfinite(v)
            codes = np.full(self.n, -1)
            values, codes[known] = np.unique(v[known], return_inverse=True)
            self.codes[name], self.levels[name] = codes, max(1, len(values))
            self.mask_of[name] = masks.setdefault(known.tobytes(), (len(masks), known))

    def scores(self, at: np.ndarray, pairs: Sequence[tuple[str, str]], k: int) -> list[list[tuple[float, bool]]]:
        """Per pair the (gcc, valid) of every replicate; ``at`` holds one row of positions per replicate."""
        if self.n <= k + 1:
            return [[(np.nan, False)] * len(at) for _ in pairs]
        lags = {(x, y, side): np.full((k + 1, len(at)), np.nan) for x, y in pairs for side in ("xx", "yy", "xy", "yx")}
        drawn = {c: self.codes[c][at] for c in {c for p in pairs for c in p}}
        known = {i: m[at] for i, m in self.mask_of.values()}
        for h in range(k + 1):
            ranks: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
            for x, y in pairs:
                for side, u, v in (("xx", x, x), ("yy", y, y), ("xy", x, y), ("yx", y, x)):
                    both = self.mask_of[u][0], self.mask_of[v][0]
                    for name, late in ((u, False), (v, True)):
                        if (name, late, both) not in ranks:
                            ok = known[both[0]][:, :self.n - h] & known[both[1]][:, h:]
                            part = drawn[name][:, h:] if late else drawn[name][:, :self.n - h]
                            ranks[name, late, both] = _centred_ranks(part, ok, self.levels[name])
                    (a, na), (b, nb) = ranks[u, False, both], ranks[v, True, both]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        rho = np.einsum("ij,ij->i", a, b) / np.sqrt(na * nb)
                    lags[x, y, side][h] = np.where(na * nb > 0, rho, np.nan)
        return [[gcc_of_lags(*(lags[x, y, side][:, r] for side in ("xx", "yy", "xy", "yx"))) for r in range(len(at))]
                for x, y in pairs]


def _centred_ranks(codes: np.ndarray, ok: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Average ranks less their mean along each row over the places in ``ok`` (0 elsewhere), and their squared norms."""
    cell = np.arange(len(codes))[:, None] * levels + codes
    count = np.bincount(cell[ok], minlength=len(codes) * levels).reshape(len(codes), levels)
    middle = count.cumsum(axis=1) - (count - 1) / 2.0 - (count.sum(axis=1, keepdims=True) + 1) / 2.0
    out = np.where(ok, middle.ravel()[np.where(ok, cell, 0)], 0.0)
    return out, np.einsum("ij,ij->i", out, out)


def block_bootstrap_pairs(df: DataFrame, key: Sequence[str], pos: str, pairs: Sequence[tuple[str, str]],
                          replicates: int = 10000, k: int = 7, block_len: int | None = None, seed: int = 123,
                          chunk: int = 32) -> DataFrame:
    """Spearman GCC of every replicate and pair of variables: ``(key, replicate, pair, gcc, valid)``.

    All pairs are scored on the same replicates: the starts of ``chunk`` replicates (the hashes of
    ``block_replicates``) travel with the series, positions are laid out and scored inside the task, and only
    scores leave it.  NULL and NaN values drop out of the lag pairs they belong to.  The series is bounded by the
    calendar; work is spread over (key, chunk).
    """
    key, names = list(key), list(dict.fromkeys(c for p in pairs for c in p))
    row = F.struct(F.col(pos).alias("p"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    series = df.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("__s"))
    series = series.select(*key, *[F.col(f"__s.v{i}").alias(f"__v{i}") for i in range(len(names))], F.size("__s").alias("__n"))
    length = F.lit(block_len) if block_len else F.greatest(F.lit(1), F.round(F.col("__n") / 4.0).cast("int"))
    chunks = -(-replicates // chunk)
    width = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chunks // 4))
    # A fixed number of tasks: the rows are few and small, but each stands for much work.
    spread = (series.withColumn("__len", length.cast("int")).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
              .repartition(width, *key, "__chunk"))
    first = (F.col("__chunk") * chunk + 1).cast("bigint")
    numbers = F.sequence(first, F.least(first + chunk - 1, F.lit(replicates).cast("bigint")))
    blocks = F.sequence(F.lit(0), (F.ceil(F.col("__n") / F.col("__len")) - 1).cast("int"))
    starts = F.transform(numbers, lambda r: F.transform(blocks, lambda b: block_draw(seed, r, b, F.col("__n"))))
    schema = T.StructType([df.schema[c] for c in key] + [
        T.StructField("replicate", T.LongType()), T.StructField("pair", T.StringType()),
        T.StructField("gcc", T.DoubleType()), T.StructField("valid", T.BooleanType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                series = _Series({c: np.asarray(r[f"__v{i}"], dtype=float) for i, c in enumerate(names)})
                begin = np.stack([np.asarray(s) for s in r["__starts"]])
                at = (begin[:, :, None] + np.arange(r["__len"])).reshape(len(begin), -1)[:, :series.n] % series.n
                for (x, y), got in zip(pairs, series.scores(at, pairs, k), strict=True):
                    yield pd.DataFrame({
                        **{c: [r[c]] * len(at) for c in key}, "replicate": r["__first"] + np.arange(len(at)),
                        "pair": f"{x}~{y}", "gcc": [None if np.isnan(g) else g for g, _ in got], "valid": [v for _, v in got]})

    ready = spread.select(*key, *[f"__v{i}" for i in range(len(names))], "__len", starts.alias("__starts"), first.alias("__first"))
    return ready.mapInPandas(score, schema)


def percentile_ci(samples: DataFrame, key: Sequence[str], alpha: float = 0.05, value: str = "gcc") -> DataFrame:
    """Percentile interval of the replicates per key."""
    return exact_quantiles(samples, value, {"ci_low": alpha / 2, "ci_high": 1 - alpha / 2}, key)
