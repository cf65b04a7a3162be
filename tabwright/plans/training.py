"""From a raw table to ranked learners."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import numeric_columns
from tabwright.functions.sampling import train_test
from tabwright.operators.clean import DEFAULT_CONFIG, fit_scale, handle_missing, handle_outliers
from tabwright.operators.evaluate import residual_summary
from tabwright.operators.features import Encoder, exclude, fit_encoder
from tabwright.operators.models import Fitted, rank_candidates
from tabwright.operators.profile import problem_type

MIN_ROWS = 4
TASKS = ("regression", "classification")
STEP_LOG = "step string, detail string"


def clean(df: DataFrame, config: Mapping[str, object] | None = None, keep: Sequence[str] = ()):
    """(table, log): exclude features, fill blanks, treat outliers, in this order.

    `keep` names keys and the target: their blanks and outliers are left alone.
    """
    config = {**DEFAULT_CONFIG, **(config or {})}
    spark = df.sparkSession
    log = []
    excluded = [c for c in config["exclude"] if c in df.columns]
    if excluded:
        df = exclude(df, excluded)
        log.append(("exclude", ", ".join(excluded)))
    columns = [c for c in df.columns if c not in keep]
    df, filled = handle_missing(df, config["missing"], columns)
    log += [("missing", f"{r.column}: {r.n_filled} by {r.strategy} ({r.fill_value})") for r in filled.collect()]
    numbers = [c for c in numeric_columns(df) if c in columns]
    df, treated = handle_outliers(df, numbers, config["outliers"], config["outlier_factor"])
    log += [
        ("outliers", f"{r.column}: {r.n_affected} {r.method} [{r.low:.2f}, {r.high:.2f}]") for r in treated.collect()
    ]
    return df, spark.createDataFrame(log, STEP_LOG)


@dataclass
class Prepared:
    """Encoded rows (row_id, label, features) with everything needed to encode new ones."""

    table: DataFrame
    encoder: Encoder
    classification: bool
    log: DataFrame
    target_min: float | None


def prepare(
    df: DataFrame, target: str, key: str, config: Mapping[str, object] | None = None, task: str | None = None
) -> Prepared:
    """Clean, choose and encode features, detect the task unless it is named, scale.

    The detected task follows the share of distinct values, which falls as a table grows: a caller who
    means "regression" or "classification" at any size says so.
    """
    if task not in (None, *TASKS):
        raise ValueError(f"unknown task {task!r}")
    config = {**DEFAULT_CONFIG, **(config or {})}
    df = df.where(F.col(target).isNotNull())
    detected = problem_type(df, target).first()
    if detected.n_rows < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} rows are needed")
    cleaned, log = clean(df, config, keep=(key, target))
    encoder = fit_encoder(cleaned, target, keys=[key])
    if task == "regression" and encoder.labels is not None:
        raise ValueError(f"{target} holds no numbers")
    if not encoder.feature_names:
        raise ValueError("no usable feature is left")
    if config["scaling"] != "none":
        plain = encoder.encode(cleaned)
        encoder.scales = fit_scale(plain, encoder.feature_names, config["scaling"])
    rows = encoder.training(cleaned, [key]).withColumnRenamed(f"key_{key}", "row_id")
    low = None if encoder.labels is not None else rows.agg(F.min("label")).first()[0]
    return Prepared(rows, encoder, (task or detected.problem_type) == "classification", log, low)


@dataclass
class Training:
    prepared: Prepared
    leaderboard: DataFrame
    learners: dict[str, Fitted]
    residuals: DataFrame | None

    @property
    def best(self) -> Fitted:
        return self.learners[self.leaderboard.where("status = 'ok'").first().algorithm]


def train(
    df: DataFrame,
    target: str,
    key: str,
    config: Mapping[str, object] | None = None,
    algorithms: Sequence[str] | None = None,
    folds: int = 0,
    task: str | None = None,
) -> Training:
    """Prepare a table, split it 80/20 by key, fit and rank the learners, look at the best one's residuals."""
    ready = prepare(df, target, key, config, task)
    train_rows, test_rows = train_test(ready.table, ["row_id"])
    board, learners = rank_candidates(
        train_rows, test_rows, ready.encoder.feature_names, ready.classification, algorithms, folds
    )
    result = Training(ready, board, learners, None)
    if not ready.classification:
        result.residuals = residual_summary(result.best.predict(test_rows), "label", "prediction")
    return result


def leaderboard_entries(result: Training, user_id: str, dataset: str, eval_mode: str = "split") -> DataFrame:
    """The leaderboard in the columns of the result store."""
    ready = result.prepared
    return result.leaderboard.where("status = 'ok'").select(
        F.lit(user_id).alias("user_id"),
        F.concat_ws("-", F.lit(dataset), F.lit(ready.encoder.target), "algorithm").alias("model_id"),
        "algorithm",
        F.lit("classification" if ready.classification else "regression").alias("problem_type"),
        F.lit(dataset).alias("dataset_name"),
        F.lit(ready.encoder.target).alias("target_column"),
        F.col("test_metrics").alias("metrics"),
        "feature_importance",
        "duration_sec",
        F.lit(eval_mode).alias("eval_mode"),
        F.lit(len(ready.encoder.feature_names)).alias("num_features"),
        F.lit(ready.table.count()).alias("num_samples"),
    )
