"""Statistical column expressions, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_if_nan(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN -> NULL for the named floating-point columns."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({
        c: F.when(~F.isnan(c), F.col(c)) for c in cols if c in floats
    }) if any(c in floats for c in cols) else df


def mean_strict(x: str | Column) -> Column:
    """Mean that is NULL as soon as one input is NULL."""
    col = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(col) == F.count(F.lit(1)), F.avg(col))


def percentile(x: str | Column, p: float) -> Column:
    """Exact interpolated quantile of a bounded group (see README, "Scale")."""
    col = F.col(x) if isinstance(x, str) else x
    return F.percentile(col, F.lit(float(p)))


def zscore_over(x: str, w: WindowSpec, strict: bool = False) -> Column:
    """(x - mean) / sample sd over a window; NULL when sd is 0 or undefined.

    ``strict`` makes the whole group NULL if any value in it is NULL.
    """
    col = F.col(x)
    z = F.try_divide(col - F.avg(col).over(w), F.nullif(F.stddev_samp(col).over(w), F.lit(0.0)))
    if strict:
        return F.when(F.count(col).over(w) == F.count(F.lit(1)).over(w), z)
    return z


def joint_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows where both values are present.

    Built from moments because ``corr`` raises a division error on a constant
    column under ANSI mode; here that case is NULL.
    """
    a = F.col(x) if isinstance(x, str) else x
    b = F.col(y) if isinstance(y, str) else y
    both = a.isNotNull() & b.isNotNull()
    xa, yb = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(xa) * F.stddev_pop(yb)
    return F.try_divide(F.covar_pop(xa, yb), F.nullif(spread, F.lit(0.0)))
