"""Queries over training results: ranks, runs, days, totals, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.ranking import numbered

# The score of an entry by its problem type, first metric present wins.
SCORE_METRICS = {"classification": ("f1", "accuracy"), "regression": ("r2",)}


def entry_score(problem_type: Column, metrics: Column) -> Column:
    """Score of an entry from its metrics map; 0 when it has none."""

    def first(names):
        return F.coalesce(*[F.nullif(F.element_at(metrics, F.lit(n)), F.lit(0.0)) for n in names], F.lit(0.0))

    return F.when(problem_type == "classification", first(SCORE_METRICS["classification"])).otherwise(
        first(SCORE_METRICS["regression"])
    )


def filter_entries(df: DataFrame, algorithm: str | None = None, problem_type: str | None = None) -> DataFrame:
    """Entries without baselines, by algorithm and problem type."""
    df = df.where(F.col("algorithm") != "baseline")
    if algorithm:
        df = df.where(F.col("algorithm") == algorithm)
    return df.where(F.col("problem_type") == problem_type) if problem_type else df


def search(df: DataFrame, columns: Sequence[str], words: str) -> DataFrame:
    """Case-insensitive substring search on any of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(F.lit(words)))
    return df.where(found)


def ranked(df: DataFrame, score: str, tie: str, descending: bool = True) -> DataFrame:
    """Place of every entry by score."""
    return numbered(df, [(score, not descending), (tie, True)], name="place")


def run_numbers(df: DataFrame, group: str, time: str, tie: str) -> DataFrame:
    """Run number of each entry within its group, oldest first."""
    return numbered(df, [(time, True), (tie, True)], [group], "run")


def run_trend(runs: DataFrame, group: str, score: str, groups: Sequence[str]) -> DataFrame:
    """One row per run number with the score of every group that got that far."""
    return runs.groupBy("run").pivot(group, list(groups)).agg(F.first(score))


def best_per_day(df: DataFrame, time: str, score: str, group: str) -> DataFrame:
    """Best score, who reached it and the number of entries per day."""
    best = F.max_by(F.col(group), F.struct(F.col(score), F.col(group)))
    return df.groupBy(F.to_date(time).alias("day")).agg(
        F.max(score).alias("best"), best.alias("best_group"), F.count(F.lit(1)).alias("n")
    ).withColumn("label", F.date_format("day", "MMM d"))


def per_group(df: DataFrame, group: str, score: str) -> DataFrame:
    """Entries and mean score per algorithm, best first."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score")).orderBy(
        F.desc("mean_score"), group
    )


def totals(df: DataFrame, group: str, score: str, duration: str, dataset: str, time: str) -> DataFrame:
    """One row: entries, best and mean score, total time, data sets, best and most used algorithm."""
    usage = df.groupBy(group).agg(F.count(F.lit(1)).alias("uses"))
    used, kinds = usage.agg(F.max_by(group, F.struct(F.col("uses"), F.col(group))), F.count(F.lit(1))).first()
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(score).alias("best"),
        F.avg(score).alias("mean"),
        F.sum(duration).alias("total_duration"),
        F.countDistinct(dataset).alias("n_datasets"),
        F.max_by(group, F.struct(F.col(score), F.col(group))).alias("best_group"),
        F.max(time).alias("last_time"),
        F.lit(used).alias("most_used"),
        F.lit(kinds).cast("long").alias("n_groups"),
    )


def top(df: DataFrame, score: str, tie: str, k: int = 5) -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(k)


def newest(df: DataFrame, time: str, tie: str, limit: int = 50, without: Sequence[str] = ()) -> DataFrame:
    """The newest rows, heavy columns left out before they are read."""
    return df.drop(*without).orderBy(F.desc(time), F.desc(tie)).limit(limit)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; merged before the shuffle, so a frequent key costs no more."""
    rest = [c for c in df.columns if c not in keys]
    chosen = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "_row.*")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    chosen = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "_row.*")


def fingerprint(dataset: Column, target: Column, algorithms: Column, mode: Column) -> Column:
    """Key of an analysis: data set, target, sorted algorithms and mode."""
    return F.concat_ws(
        "|", dataset, F.coalesce(target, F.lit("unsupervised")), F.array_join(F.array_sort(algorithms), ","), mode
    )


def not_in(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a partner: models not yet deployed."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def only_in(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a partner: the selected models."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def lookup(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their partner."""
    return df.join(other, list(keys))


def best_model(df: DataFrame, group: str | None = None) -> DataFrame:
    """The model with the best score, the first one on a tie."""
    chosen = F.max_by("model_id", F.struct(F.col("score"), (-F.col("position")).alias("p"))).alias("model_id")
    best = F.max("score").alias("score")
    return (df.groupBy(group) if group else df.groupBy()).agg(chosen, best)
