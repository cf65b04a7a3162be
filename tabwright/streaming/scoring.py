"""Scoring rows as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_arrivals(
    arrivals: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    deploy_id: str,
    output: str,
    checkpoint: str,
) -> StreamingQuery:
    """Start a query that scores arriving rows and appends them under `output`.

    Each batch is written under its number, so a batch that runs again after a lost driver
    replaces its first try and no row is scored twice. The query ends with the rows at hand.
    """

    def write(batch: DataFrame, number: int) -> None:
        scored = score(batch).withColumn("deploy_id", F.lit(deploy_id))
        inner = [f.name for f in scored.schema if f.dataType.typeName() == "vectorudt"]
        scored.drop(*inner).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (
        arrivals.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
