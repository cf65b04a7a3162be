"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

JOBS_AT_ONCE = 4


def local_session(app: str = "tabwright", cores: int | str = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder `spark.checkpoint.dir` names; a scratch one only for local runs without it."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current:
        return current
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tabwright-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def side_by_side(run: Callable, items: Iterable, at_once: int = JOBS_AT_ONCE) -> list:
    """`run` on every item, a few at a time, results in order: independent fits share the cluster."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inherit(run), items))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet under the checkpoint folder and go on from the written copy.

    For loops: the planner sees the real size of the copy. After `cut_lineage` it goes on from a
    guess, and guesses multiply with every join until their numbers alone take minutes.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
