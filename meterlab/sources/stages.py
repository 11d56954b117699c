"""Materialised intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a local default exists only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meterlab-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def materialise(df: DataFrame) -> DataFrame:
    """Write once as a table in the shared checkpoint folder and read it from there afterwards.

    Meant for results that are small next to their cost (one row per household
    or per replicate) and are used several times.  Survives lost executors, cuts
    the lineage, and gives later joins the true size to plan with (a plain
    checkpoint keeps the estimated size, which explodes over iterations).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(*stages: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for df in stages:
        path = getattr(df, "_stage_path", None) if "_stage_path" in vars(df) else None
        if path is not None:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
