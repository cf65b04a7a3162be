"""Intermediate tables in the shared checkpoint folder, and size-checked broadcasts."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.session import ensure_checkpoint_dir

BROADCAST_ROWS = 1_000_000


def keep(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet under the checkpoint folder and go on from the written copy.

    A lost executor then costs a re-read, not a re-run, and the planner knows the real size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Have shuffles that nothing refers to any more removed now, not at the driver's next garbage collection.

    For steps that shuffle about as much as their input, one after the other.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Remove what `keep` wrote in this application; results that still read from it are void."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        if status.getPath().getName().startswith("kept-"):
            system.delete(status.getPath(), True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it was counted to have at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
