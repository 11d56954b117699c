"""Named queries: a Spark function and, where SQL can say it, its SQL twin.

Both sides are projected to the same columns; floating-point columns are rounded
to six decimals.  The tiny shift before rounding settles exact ties (means of
two-decimal values) the same way in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHIFT = 1e-10


def _spark_columns(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    small = (T.IntegerType, T.ShortType, T.ByteType)
    cols = []
    for k in keys:
        c = F.col(k).cast("bigint") if isinstance(df.schema[k].dataType, small) else F.col(k)
        cols.append(c.alias(k))
    cols += [F.round(F.col(v).cast("double") + SHIFT, 6).alias(v) for v in values]
    return df.select(*cols)


def query(name: str, keys: str, values: str = "", sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` with its exact and rounded columns."""
    ks, vs = keys.split(), values.split()

    def wrap(fn: Query) -> Query:
        QUERIES[name] = lambda spark, d: _spark_columns(fn(spark, d), ks, vs)
        if sql is not None:
            cols = ks + [f"round(CAST({v} AS DOUBLE) + {SHIFT}, 6) AS {v}" for v in vs]
            ORACLES[name] = f"SELECT {', '.join(cols)} FROM (\n{sql.strip()}\n) AS result"
        return fn

    return wrap
