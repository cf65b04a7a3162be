"""Queries over the activity log, users and snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_where(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row of conditional counts from one scan."""
    return df.agg(*[F.count_if(test).alias(name) for name, test in conditions.items()])


def since(time: str, now: Column, days: int = 7) -> Column:
    """Rows of the last days before `now`."""
    return F.col(time) >= now - F.make_interval(days=F.lit(days))


def user_usage(
    users: DataFrame, key: str, counted: Mapping[str, DataFrame], sessions: DataFrame, time: str, created: str
) -> DataFrame:
    """Per user: rows in each table and the last session, or the sign-up time without one.

    Every side is added up per user before it is joined.
    """
    out = users
    for name, table in counted.items():
        out = out.join(table.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").fillna(0, [name])
    last = sessions.groupBy(key).agg(F.max(time).alias("_last"))
    out = out.join(last, key, "left")
    return out.withColumn("last_active", F.coalesce("_last", created)).drop("_last")


def activity(df: DataFrame, time: str, tie: str, action: str | None = None, limit: int = 50) -> DataFrame:
    """The newest log rows, by action if wanted."""
    chosen = df.where(F.col("action") == action) if action else df
    return chosen.orderBy(F.desc(time), F.desc(tie)).limit(limit)


def activity_total(df: DataFrame, action: str | None = None) -> DataFrame:
    return (df.where(F.col("action") == action) if action else df).agg(F.count(F.lit(1)).alias("total"))


def upserted(df: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """One row per key: values of the last save, created at the first and updated at the last."""
    rest = [c for c in df.columns if c not in (*keys, time)]
    return (
        df.groupBy(*keys)
        .agg(
            F.min(time).alias("created_at"),
            F.max(time).alias("updated_at"),
            F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_row"),
        )
        .select(*keys, "created_at", "updated_at", "_row.*")
    )


def without_keys(df: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is left once the rows of the given keys are gone."""
    return df.join(removed.select(*keys).distinct(), list(keys), "left_anti")
