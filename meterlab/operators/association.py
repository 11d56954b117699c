"""Association of two categories: contingency table, chi-square, Cramer's V."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of (a, b) with marginal totals; NULLs are left out.

    The marginals are windows over one row per category pair, not over data rows.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumns({
        "row_total": F.sum("n").over(Window.partitionBy(a)),
        "col_total": F.sum("n").over(Window.partitionBy(b)),
    })


def chi_square(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """Chi-square statistic, degrees of freedom, sizes: one row.

    Empty cells need no row: chi2 = n (sum O^2 / (R C) - 1).  A 2 x 2 table gets
    the continuity correction unless ``yates`` is off.
    """
    cells = contingency(df, a, b)
    o, r, c = (F.col(x).cast("double") for x in ("n", "row_total", "col_total"))
    row = cells.agg(
        F.sum("n").alias("n"), F.count_distinct(a).alias("n_rows"), F.count_distinct(b).alias("n_cols"),
        F.sum(o * o / (r * c)).alias("__s"),
        # For a 2 x 2 table |ad - bc| equals |n a - R C| of any cell.
        F.max_by(F.struct(o.alias("o"), r.alias("r"), c.alias("c")), F.struct(F.col(a), F.col(b))).alias("__cell"))
    n = F.col("n").cast("double")
    plain = n * (F.col("__s") - 1)
    gap = F.abs(n * F.col("__cell.o") - F.col("__cell.r") * F.col("__cell.c"))
    sides = F.col("__cell.r") * (n - F.col("__cell.r")) * F.col("__cell.c") * (n - F.col("__cell.c"))
    corrected = n * F.pow(gap - F.least(gap, n / 2), F.lit(2.0)) / F.nullif(sides, F.lit(0.0))
    two = (F.col("n_rows") == 2) & (F.col("n_cols") == 2) & F.lit(yates)
    return row.select("n", "n_rows", "n_cols",
                      ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).alias("dof"),
                      F.when(two, corrected).otherwise(plain).alias("chi2"))


def _upper_tail(chi2: float, dof: int) -> float:
    """P(X >= chi2) of a chi-square variable: a finite sum of Poisson terms, for odd dof beside the normal tail."""
    half = chi2 / 2.0
    if half <= 0:
        return 1.0
    if dof % 2 == 0:
        k, term = 0.0, -half
        total = math.exp(term)
    else:
        k, total = 0.5, math.erfc(math.sqrt(half))
        term = -half + 0.5 * math.log(half) - math.lgamma(1.5)
        total += math.exp(term) if dof > 1 else 0.0
    while k + 1 < dof / 2.0:
        k += 1
        term += math.log(half) - math.log(k)
        total += math.exp(term)
    return min(1.0, total)


def chi_square_p_value(df: DataFrame, a: str, b: str, yates: bool = False) -> DataFrame:
    """Chi-square test with p-value, from the one row of ``chi_square``; no limit on the number of levels."""
    @F.udf("double")
    def tail(chi2, dof):
        return None if chi2 is None or not dof else _upper_tail(chi2, dof)

    test = chi_square(df, a, b, yates)
    return test.select("chi2", F.col("dof").cast("bigint").alias("dof"), tail("chi2", "dof").alias("p_value"))


def cramers_v(df: DataFrame, a: str, b: str, bias_correct: bool = True) -> DataFrame:
    """Cramer's V, by default with the small-sample bias correction."""
    test = chi_square(df, a, b, yates=False)
    n, r, c = (F.col(x).cast("double") for x in ("n", "n_rows", "n_cols"))
    phi2 = F.col("chi2") / n
    if bias_correct:
        phi2 = F.greatest(F.lit(0.0), phi2 - F.try_divide((r - 1) * (c - 1), n - 1))
        r = r - F.try_divide(F.pow(r - 1, F.lit(2.0)), n - 1)
        c = c - F.try_divide(F.pow(c - 1, F.lit(2.0)), n - 1)
    span = F.least(r - 1, c - 1)
    return test.select("n", F.sqrt(F.try_divide(phi2, F.nullif(span, F.lit(0.0)))).alias("cramers_v"))
