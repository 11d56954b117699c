"""Writers: tables partitioned by block, audits and intermediate stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_block(df: DataFrame, path: str, block: str = "file", fmt: str = "parquet",
                   files_per_block: int | None = None, mode: str = "overwrite", overwrite: str = "static") -> None:
    """One folder per block.

    Files follow bytes: adaptive execution splits a large block over several tasks and gives a small one a single file.
    With ``files_per_block`` rows are dealt to that many files by a hash instead.  ``overwrite="dynamic"`` replaces only
    the blocks that ``df`` holds, so a block can be written again without touching the others.
    """
    if files_per_block is None:
        dealt = df.hint("rebalance", block)
    else:
        dealt = df.repartition(block, F.pmod(F.xxhash64(*df.columns), F.lit(files_per_block)))
    (dealt.write.mode(mode).option("partitionOverwriteMode", overwrite).partitionBy(block).format(fmt)
     .option("header", True).save(path))


def write_block_files(df: DataFrame, path: str, block: str = "file") -> None:
    """One CSV file per block, named after it, as sources are exchanged; blocks are files, so each is written by one task."""
    spark = df.sparkSession
    write_by_block(df, path, block, "csv", files_per_block=1)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in [f.getPath() for f in fs.listStatus(root) if f.isDirectory()]:  # names only; one entry per block
        name = folder.getName().split("=", 1)[1]
        for f in fs.listStatus(folder):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(root, f"{name}.csv"))
        fs.delete(folder, True)


def write_removed_ids(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Audit table ``(id_removed, block, motive)`` partitioned by block."""
    df.write.mode(mode).partitionBy("block").parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Plain stage table (block variance, household flags)."""
    df.write.mode(mode).parquet(path)


write_block_variance = write_table
write_households = write_table


def write_hourly(df: DataFrame, path: str, files_per_block: int | None = None) -> None:
    """Clean hourly table by block."""
    write_by_block(df, path, "file", "parquet", files_per_block)


def write_stationary(df: DataFrame, path: str, files_per_block: int | None = None) -> None:
    """Stationary table by block."""
    write_by_block(df, path, "file", "parquet", files_per_block)
