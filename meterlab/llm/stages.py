"""Stage tables of the operators: written once to the shared folder, read as often as needed.

A stage cuts the lineage: a lost executor costs its running tasks, never the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from meterlab.sources.stages import ensure_checkpoint_dir


def stage_path(spark: SparkSession) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm/{uuid.uuid4().hex}"


#: Stage tables of this session that nobody has dropped.
_made: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete all stage tables made so far, once the results that read them are written elsewhere."""
    drop(spark, *_made)


def keep(df: DataFrame, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` as a stage table; returns the table as read back, and its path."""
    path = stage_path(df.sparkSession)
    _made.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete stage tables nothing reads any more, to free the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(paths):
        if path in _made:
            _made.remove(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
