"""Which column to predict, which columns matter, and what to do before training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import categorical_columns, number, numeric_columns, ratio
from tabwright.functions.statistics import iqr_bounds
from tabwright.operators.profile import distinct_counts, missing_cells, scale_spread

# Column-name words that mark amounts, outcomes and identifiers.
AMOUNT_WORDS = (
    "charges", "charge", "cost", "price", "amount", "salary", "income", "revenue", "profit", "loss",
    "fee", "premium", "insurance", "payment", "spend", "expense", "total", "sales",
)
OUTCOME_WORDS = (
    "target", "label", "class", "output", "result", "outcome", "status", "approved", "churned",
    "survived", "default",
)
IDENTITY_WORDS = ("id", "index", "name", "date", "timestamp", "key")


def has_word(name: Column, words: Sequence[str]) -> Column:
    return F.lower(name).rlike("|".join(words))


def key_variables(columns: DataFrame, n: int = 5) -> DataFrame:
    """The n columns of a profile with the highest interest score."""
    unique, kind = F.col("n_unique"), F.col("type")
    score = (
        F.when((kind == "numeric") & (F.col("std") > 0), 3).otherwise(0)
        + F.when((kind == "categorical") & unique.between(2, 10), 4).otherwise(0)
        + F.when(unique == 2, 2).otherwise(0)
        + F.when(F.col("n_missing") == 0, 1).otherwise(0)
    )
    return columns.withColumn("score", score).orderBy(F.desc("score"), "position").limit(n).select("name", "type", "score")


def suggest_target(columns: DataFrame) -> DataFrame:
    """Target by four rules in order: named amount, named outcome, fewest classes, any varied number."""
    unique, kind, name = F.col("n_unique"), F.col("type"), F.col("name")
    varied = (kind == "numeric") & (unique > 10) & (F.col("std") > 0)
    classes = (kind == "categorical") & unique.between(2, 10)
    rule = (
        F.when(varied & (has_word(name, AMOUNT_WORDS) | has_word(name, OUTCOME_WORDS)), 1)
        .when(classes & has_word(name, OUTCOME_WORDS), 2)
        .when(classes, 3)
        .when(varied, 4)
    )
    within = F.when(F.col("rule") == 3, unique).otherwise(0)
    return (
        columns.withColumn("rule", rule)
        .where("rule IS NOT NULL")
        .orderBy("rule", within, "position")
        .limit(1)
        .select("name", "rule", F.when(kind == "numeric", "regression").otherwise("classification").alias("task"))
    )


def score_targets(columns: DataFrame, n_rows: int) -> DataFrame:
    """Every column with its additive target score; identifier-like and near-unique ones lose points."""
    unique, kind, name = F.col("n_unique"), F.col("type"), F.col("name")
    amount, outcome = has_word(name, AMOUNT_WORDS), has_word(name, OUTCOME_WORDS)
    variation = F.least(F.lit(5.0), F.col("std") / F.when(F.abs("mean") > 0, F.abs("mean")).otherwise(1.0))
    shape = (
        F.when((kind == "categorical") & unique.between(2, 10), (F.lit(20) - unique).cast("double"))
        .when(
            (kind == "numeric") & (unique > 10),
            F.lit(5.0) + variation + F.when(unique > n_rows * 0.5, 8.0).otherwise(0.0),
        )
        .otherwise(0.0)
    )
    wanted = (kind == "numeric") & (amount | outcome)
    score = (
        F.when(outcome, 20.0).otherwise(0.0)
        + F.when(amount & (kind == "numeric"), 25.0).otherwise(0.0)
        + shape
        - F.when(has_word(name, IDENTITY_WORDS), 30.0).otherwise(0.0)
        - F.when((unique > n_rows * 0.8) & ~wanted, 20.0).otherwise(0.0)
    )
    task = F.when(kind == "categorical", "classification").otherwise("regression")
    return columns.select("position", "name", task.alias("task"), score.alias("score"))


def best_target(columns: DataFrame, n_rows: int) -> DataFrame:
    """The highest scored column, if any score is above zero."""
    return (
        score_targets(columns, n_rows)
        .where("score > 0")
        .orderBy(F.desc("score"), "position")
        .limit(1)
        .select("name", "task", "score")
    )


def suggest_task(columns: DataFrame, n_rows: int) -> DataFrame:
    """The task each column of a profile would pose as the target."""
    unique, kind = F.col("n_unique"), F.col("type")
    task = (
        F.when(kind != "numeric", "classification")
        .when(unique == 2, "binary classification")
        .when(ratio(unique, F.lit(n_rows)) < 0.05, "multi-class classification")
        .otherwise("regression")
    )
    return columns.select("name", "n_unique", task.alias("task"))


def recommendations(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row per preprocessing step worth taking: (rule, severity, n_columns, columns, action)."""
    spark = df.sparkSession
    n_rows = df.count()
    numbers = numeric_columns(df)
    rows = []

    missing = [r for r in missing_cells(df).collect() if r.n_missing > 0]
    if missing:
        high = [r.name for r in missing if r.n_missing / n_rows > 0.3]
        rows.append(
            ("missing", "high" if high else "medium", high or [r.name for r in missing], "median" if high else "auto")
        )

    bounds = iqr_bounds(df, numbers, min_rows=10, skip_flat=True)
    if bounds:
        shares = df.agg(
            *[
                ratio(F.count_if(~number(df, c).between(low, high)), F.count(number(df, c))).alias(c)
                for c, (low, high) in bounds.items()
            ]
        ).first()
        wide = {c: shares[c] for c in bounds if shares[c] > 0.03}
        if wide:
            rows.append(("outliers", "high" if max(wide.values()) > 0.1 else "medium", list(wide), "clip"))

    if len(numbers) >= 2 and scale_spread(df, numbers).first().scale_issue:
        rows.append(("scaling", "medium", numbers, "standard"))

    words = [c for c in categorical_columns(df) if c != target]
    if words:
        kinds = {r.name: r.n_unique for r in distinct_counts(df, words).collect()}
        crowded = [c for c in words if kinds[c] > 20]
        if crowded:
            rows.append(("cardinality", "low", crowded, "exclude"))
    if numbers:
        spreads = [F.var_pop(number(df, c)).alias(f"v{i}") for i, c in enumerate(numbers)]
        spreads += [F.count(number(df, c)).alias(f"k{i}") for i, c in enumerate(numbers)]
        found = df.agg(*spreads).first()
        flat = [c for i, c in enumerate(numbers) if found[f"k{i}"] >= 5 and found[f"v{i}"] < 0.001]
        if flat:
            rows.append(("variance", "low", flat, "exclude"))
    return spark.createDataFrame(
        [(rule, severity, len(names), "|".join(sorted(names)), action) for rule, severity, names, action in rows],
        "rule string, severity string, n_columns long, columns string, action string",
    )
