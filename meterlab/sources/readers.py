"""Readers: readings, weather and household tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the raw half-hourly files and the weather columns nobody uses.
RAW_ID, RAW_TIME, RAW_ENERGY = "LCLid", "tstp", "energy(kWh/hh)"
WEATHER_UNUSED = (
    "wind_speed_100m_km_h", "wind_direction_100m",
    "cloud_cover_low_percent", "cloud_cover_mid_percent", "cloud_cover_high_percent",
)
WEATHER_CODE = "weather_code_wmo_code"


def snake_case(name: str) -> str:
    """``energy(kWh/hh)`` -> ``energy_k_wh_hh``; ``temperature_2m (%)`` -> ``temperature_2m_percent``."""
    text = name.replace("%", "_percent_").replace("°", "")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    return re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()


def clean_names(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Snake-case every column name, number repeats, then apply ``rename``."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = snake_case(c)
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names).withColumnsRenamed(rename or {})


def to_local_ts(col: str | Column) -> Column:
    """Parse ``yyyy-MM-dd HH:mm:ss`` text as wall-clock time of the session time zone.

    Text that does not parse becomes NULL.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))


def block_tag() -> Column:
    """Block name of a row's source file: its file name without ``.csv``."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")


def read_readings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All half-hourly block files of a folder as one table.

    Energy that is not a number becomes NULL.  ``file`` is the block name.
    """
    raw = spark.read.option("header", True).csv(path)
    tagged = raw.select(
        F.col(RAW_ID), to_local_ts(RAW_TIME).alias(RAW_TIME),
        F.col(f"`{RAW_ENERGY}`").try_cast("double").alias(RAW_ENERGY), block_tag().alias("file"))
    return clean_names(tagged, {"lclid": "lc_lid", "energy_k_wh_hh": "energy_kwh_hh"})


def load_weather(df: DataFrame, time: str = "time", drop: Iterable[str] = WEATHER_UNUSED) -> DataFrame:
    """Weather with clean names, parsed local time, unused columns dropped, code as category."""
    out = clean_names(df)
    if dict(out.dtypes)[time] == "string":
        out = out.withColumn(time, F.coalesce(
            to_local_ts(time), F.try_to_timestamp(F.col(time), F.lit("yyyy-MM-dd'T'HH:mm"))))
    out = out.drop(*drop)
    if WEATHER_CODE in out.columns:
        out = out.withColumn(WEATHER_CODE, F.col(WEATHER_CODE).cast("string"))
    return out


def read_weather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Weather CSV with an explicit schema."""
    return load_weather(spark.read.option("header", True).schema(schema).csv(path))


def incomplete_rows(df: DataFrame) -> DataFrame:
    """Rows with at least one NULL."""
    bad = None
    for c in df.columns:
        bad = F.col(c).isNull() if bad is None else bad | F.col(c).isNull()
    return df.where(bad)


def read_households(spark: SparkSession, path: str) -> DataFrame:
    """Household attributes, one row per household, all text."""
    return spark.read.option("header", True).csv(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """Read an intermediate table written by :mod:`meterlab.sources.writers`."""
    return spark.read.parquet(path)
