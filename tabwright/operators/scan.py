"""Data-quality scan with its 0-100 score."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import as_rows, number, numeric_columns, present
from tabwright.functions.statistics import iqr_bounds
from tabwright.operators.profile import WIDE_SCALE, duplicate_rows, high_correlations, target_check

SCAN_SCHEMA = (
    "n_rows long, n_columns long, n_numeric long, n_categorical long, total_missing long, "
    "duplicate_rows long, total_outliers long, constant_columns long, high_correlations long, "
    "scale_issue boolean, small_data boolean, imbalanced boolean, score long, n_warnings long, ready boolean"
)


def outlier_counts(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Values outside the quartile fences, per column that has at least four values."""
    columns = columns or numeric_columns(df)
    bounds = iqr_bounds(df, columns, factor)
    if not bounds:
        return df.sparkSession.createDataFrame([], "name string, low double, high double, n_outliers long")
    counts = [
        F.count_if(~number(df, c).between(low, high)).alias(f"o{i}") for i, (c, (low, high)) in enumerate(bounds.items())
    ]
    rows = [
        F.struct(
            F.lit(c).alias("name"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.col(f"o{i}").alias("n_outliers")
        )
        for i, (c, (low, high)) in enumerate(bounds.items())
    ]
    return df.agg(*counts).select(as_rows(rows))


def quality_score(
    n_rows: int,
    n_columns: int,
    n_numeric: int,
    missing: int,
    duplicates: int,
    outliers: int,
    constants: int,
    pairs: int,
    small: bool,
    imbalanced: bool,
    scale_issue: bool,
) -> int:
    """100 less a bounded penalty per kind of defect, never below 0."""
    rows = max(n_rows, 1)
    penalty = (
        min(25, missing / (rows * max(n_columns, 1)) * 100)
        + min(15, duplicates / rows * 50)
        + min(15, outliers / (rows * (n_numeric or 1)) * 50)
        + 5 * constants
        + min(10, 2 * pairs)
        + 5 * small
        + 10 * imbalanced
        + 3 * scale_issue
    )
    return max(0, math.floor(100 - penalty + 0.5))


def _facts(df: DataFrame) -> dict[str, tuple[int, object, object]]:
    """(missing, min, max) of every column from one scan."""
    wanted = []
    for c in df.columns:
        value = present(df, c)
        wanted += [F.count_if(value.isNull()), F.min(value), F.max(value)]
    row = df.agg(*wanted).first()
    return {c: tuple(row[3 * i : 3 * i + 3]) for i, c in enumerate(df.columns)}


def scan(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: the defects of a table, its score, the number of warnings and whether it is ready."""
    numbers = numeric_columns(df)
    copies = duplicate_rows(df).first()
    facts = _facts(df)
    missing = sum(blank for blank, _, _ in facts.values())
    constants = sum(low is None or (low == high and blank == 0) for blank, low, high in facts.values())
    ranges = [float(facts[c][2]) - float(facts[c][1]) for c in numbers if facts[c][1] is not None]
    ranges = [r for r in ranges if r > 0]
    wide = len(ranges) > 1 and max(ranges) / min(ranges) > WIDE_SCALE
    outliers = sum(r.n_outliers for r in outlier_counts(df, numbers).collect()) if numbers else 0
    pairs = high_correlations(df, numbers).count() if len(numbers) > 1 else 0
    imbalanced = bool(target and target_check(df, target).first().imbalanced)
    small = copies.n_rows < 100
    score = quality_score(
        copies.n_rows, len(df.columns), len(numbers), missing, copies.n_duplicates, outliers,
        constants, pairs, small, imbalanced, wide,
    )
    warnings = sum(map(bool, (missing, copies.n_duplicates, outliers, constants, pairs, small, imbalanced, wide)))
    row = (
        copies.n_rows, len(df.columns), len(numbers), len(df.columns) - len(numbers), missing,
        copies.n_duplicates, outliers, constants, pairs, wide, small, imbalanced, score, warnings, score >= 50,
    )
    return df.sparkSession.createDataFrame([row], SCAN_SCHEMA)


def compare_scans(before: DataFrame, after: DataFrame, target: str | None = None) -> DataFrame:
    """The scan of a table before and after cleaning, one row each."""
    return (
        scan(before, target).withColumn("stage", F.lit("before")).unionByName(
            scan(after, target).withColumn("stage", F.lit("after"))
        )
    )
