"""Sources and sinks: what is written is read back and compared with the table it came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue import tables as t
from catalogue.registry import query
from meterlab.sources.readers import RAW_ENERGY, RAW_ID, RAW_TIME, read_readings, read_stage
from meterlab.sources.stages import ensure_checkpoint_dir
from meterlab.sources.writers import write_block_files, write_hourly, write_removed_ids


def _folder(spark):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/sources/{uuid.uuid4().hex}"


def _hourly_blocks(spark, d):
    return t.user_hourly(spark, d).withColumn("file", F.concat(F.lit("block_"), F.col("meter") % 8))


HOURLY_BLOCKS = t.USER_HOURLY + ", blocks AS (SELECT *, 'block_' || (meter % 8) AS file FROM user_hourly)"


@query("csv_readings", "lc_lid tstp file", "energy_kwh_hh", sql="""
SELECT CAST(user_id AS VARCHAR) AS lc_lid, CAST(date_trunc('second', ts) AS TIMESTAMP) AS tstp, 'block_' || (user_id % 8) AS file,
       CASE WHEN event_type <> 'view' THEN value END AS energy_kwh_hh FROM events""")
def csv_readings(spark, d):
    """Raw block files as CSV, some energies the text Null; blocks come back from the names of the files."""
    ev = t.table(spark, d, "events")
    raw = ev.select(F.col("user_id").cast("string").alias(RAW_ID), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(RAW_TIME),
                    F.when(F.col("event_type") == "view", "Null").otherwise(F.col("value").cast("string")).alias(RAW_ENERGY),
                    F.concat(F.lit("block_"), F.col("user_id") % 8).alias("file"))
    path = _folder(spark)
    write_block_files(raw, path)
    return read_readings(spark, path).withColumn("tstp", F.col("tstp").cast("timestamp_ntz"))


@query("hourly_read_back", "meter ts file", "energy", sql=f"WITH {HOURLY_BLOCKS} SELECT * FROM blocks")
def hourly_read_back(spark, d):
    path = _folder(spark)
    write_hourly(_hourly_blocks(spark, d), path)
    return read_stage(spark, path)


@query("hourly_one_block", "meter n", "energy", sql=f"""
WITH {HOURLY_BLOCKS}
SELECT meter, count(*) AS n, avg(energy) AS energy FROM blocks WHERE file = 'block_3' GROUP BY meter""")
def hourly_one_block(spark, d):
    """Only the folder of the block is read."""
    path = _folder(spark)
    write_hourly(_hourly_blocks(spark, d), path)
    one = read_stage(spark, path).where(F.col("file") == "block_3")
    return one.groupBy("meter").agg(F.count(F.lit(1)).alias("n"), F.avg("energy").alias("energy"))


@query("removed_read_back", "id_removed block motive", sql=f"""
WITH {HOURLY_BLOCKS}
SELECT meter AS id_removed, any_value(file) AS block, 'short' AS motive FROM blocks GROUP BY meter HAVING count(*) < 65""")
def removed_read_back(spark, d):
    few = _hourly_blocks(spark, d).groupBy("meter", "file").agg(F.count(F.lit(1)).alias("n")).where("n < 65")
    path = _folder(spark)
    write_removed_ids(few.select(F.col("meter").alias("id_removed"), F.col("file").alias("block"), F.lit("short").alias("motive")), path)
    return read_stage(spark, path)
