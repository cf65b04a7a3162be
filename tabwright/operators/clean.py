"""Cleaning: duplicates, missing values, outliers, constants and scales.

Steps that learn something from the data come as a fit that returns a few numbers and an
expression that applies them, so that new rows can be treated the same way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import clamp, number, numeric_columns, present, quoted
from tabwright.functions.statistics import iqr_bounds, order_stats
from tabwright.operators.profile import constant_columns

FILL_LOG = "column string, n_filled long, strategy string, fill_value string"
OUTLIER_LOG = "column string, n_affected long, method string, low double, high double"

# What a run does unless told otherwise.
DEFAULT_CONFIG = {
    "missing": "auto",
    "scaling": "none",
    "outliers": "none",
    "outlier_factor": 1.5,
    "exclude": (),
}


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One copy of each row; copies are merged before the shuffle, so a crowd of copies stays cheap."""
    return df.dropDuplicates()


def mode_values(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """(value, count) seen most often per column; the smaller value wins a tie."""
    found = {}
    for name in columns:
        counts = df.where(present(df, name).isNotNull()).groupBy(quoted(name)).agg(F.count(F.lit(1)).alias("_n"))
        row = counts.orderBy(F.desc("_n"), quoted(name)).first()
        if row is not None:
            found[name] = (row[0], row[1])
    return found


def fill_values(df: DataFrame, strategy: str = "auto", columns: Sequence[str] | None = None) -> dict[str, object]:
    """The value each column's blanks get under a strategy: auto, mean, median, mode or zero."""
    columns = list(columns or df.columns)
    numbers = [c for c in columns if c in numeric_columns(df)]
    words = [c for c in columns if c not in numbers]
    if strategy == "none":
        return {}
    if strategy == "zero":
        return {**dict.fromkeys(numbers, 0.0), **dict.fromkeys(words, "")}
    fills: dict[str, object] = {}
    if strategy == "mean":
        means = df.agg(*[F.avg(number(df, c)).alias(c) for c in numbers]).first() if numbers else {}
        fills = {c: 0.0 if means[c] is None else means[c] for c in numbers}
    elif strategy in ("auto", "median"):
        medians = order_stats(df, {c: (0.5,) for c in numbers})
        fills = {c: 0.0 if medians[c][0.5] is None else medians[c][0.5] for c in numbers}
    elif strategy != "mode":
        raise ValueError(f"unknown strategy {strategy!r}")
    modes = mode_values(df, words if strategy != "mode" else columns)
    missing_mode = {c: (0.0 if c in numbers else "") for c in columns}
    for c in columns if strategy == "mode" else words:
        fills[c] = modes[c][0] if c in modes else missing_mode[c]
    return fills


def fill_missing(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """Put the given values into blank cells; number columns become doubles."""
    numbers = set(numeric_columns(df))
    return df.select(
        *[
            F.coalesce(number(df, c) if c in numbers else present(df, c), F.lit(fills[c])).alias(c)
            if c in fills
            else F.col(quoted(c))
            for c in df.columns
        ]
    )


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without any blank cell (NaN counts as blank)."""
    return df.dropna("any", subset=list(columns) if columns else None)


def handle_missing(df: DataFrame, strategy: str = "auto", columns: Sequence[str] | None = None):
    """(table, log) for a strategy; `drop` removes rows, `none` does nothing."""
    spark = df.sparkSession
    columns = list(columns or df.columns)
    if strategy == "none":
        return df, spark.createDataFrame([], FILL_LOG)
    if strategy == "drop":
        kept = drop_missing(df, columns)
        return kept, spark.createDataFrame([("ALL", df.count() - kept.count(), "drop", "N/A")], FILL_LOG)
    counts = df.agg(*[F.count_if(present(df, c).isNull()).alias(c) for c in columns]).first()
    blank = [c for c in columns if counts[c]]
    fills = fill_values(df, strategy, blank) if blank else {}
    numbers = set(numeric_columns(df))

    def used(name):
        return strategy if strategy not in ("auto", "median", "mean") else (
            ("median" if strategy == "auto" else strategy) if name in numbers else "mode"
        )

    log = [
        (c, counts[c], used(c), f"{fills[c]:.2f}" if isinstance(fills[c], (int, float)) else str(fills[c])) for c in blank
    ]
    return fill_missing(df, fills), spark.createDataFrame(log, FILL_LOG)


def fill_mean_then_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column mean for blanks, 0 where a column has no value at all."""
    return fill_missing(df, fill_values(df, "mean", columns))


def outside_counts(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> dict[str, int]:
    if not bounds:
        return {}
    row = df.agg(
        *[F.count_if(~number(df, c).between(low, high)).alias(c) for c, (low, high) in bounds.items()]
    ).first()
    return row.asDict()


def _outlier_log(df, counts, bounds, method):
    return df.sparkSession.createDataFrame(
        [(c, n, method, *map(float, bounds[c])) for c, n in counts.items() if n], OUTLIER_LOG
    )


def clip_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5):
    """(table, log): values beyond the quartile fences are moved onto them."""
    bounds = iqr_bounds(df, columns, factor, skip_flat=True)
    counts = outside_counts(df, bounds)
    # least and greatest skip NULL, so blanks are kept apart
    kept = {c: F.when(number(df, c).isNotNull(), clamp(number(df, c), *bounds[c])) for c in bounds}
    clipped = df.withColumns(kept) if bounds else df
    return clipped, _outlier_log(df, counts, bounds, "clip")


def _inside(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    for c, (low, high) in bounds.items():
        x = number(df, c)
        df = df.where(x.isNull() | x.between(low, high))
    return df


def remove_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5, mode: str = "joint"):
    """(table, log): rows beyond the fences go, blanks stay.

    `joint` takes all fences from the whole table; `sequential` goes column by column and takes
    each fence from the rows left by then.
    """
    if mode == "joint":
        bounds = iqr_bounds(df, columns, factor)
        return _inside(df, bounds), _outlier_log(df, outside_counts(df, bounds), bounds, "remove")
    bounds, counts, rest = {}, {}, df
    for c in columns:
        found = iqr_bounds(rest, [c], factor, skip_flat=True)
        counts |= outside_counts(rest, found)
        bounds |= found
        rest = _inside(rest, found)
    return rest, _outlier_log(df, counts, bounds, "remove")


def handle_outliers(df: DataFrame, columns: Sequence[str], method: str = "none", factor: float = 1.5):
    if method == "none":
        return df, df.sparkSession.createDataFrame([], OUTLIER_LOG)
    if method == "clip":
        return clip_outliers(df, columns, factor)
    return remove_outliers(df, columns, factor, mode="sequential")


def drop_constants(df: DataFrame):
    """(table, names dropped)."""
    names = [r.name for r in constant_columns(df).collect()]
    return df.drop(*names), names


def normalize(df: DataFrame, columns: Sequence[str], places: int = 4) -> DataFrame:
    """Min-max to [0, 1] with four decimals; columns without spread stay."""
    scales = fit_scale(df, columns, "minmax")
    spread = {c: s for c, s in scales.items() if s.spread}
    return df.withColumns({c: F.round((number(df, c) - s.origin) / s.spread, places) for c, s in spread.items()})


@dataclass
class Scale:
    """What a column is shifted by and divided by; no spread divides by 1."""

    origin: float
    spread: float

    @property
    def divisor(self) -> float:
        return self.spread or 1.0


def fit_scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> dict[str, Scale]:
    """Mean and population deviation, or minimum and range, per column in one scan."""
    if method == "none" or not columns:
        return {}
    x = {c: number(df, c) for c in columns}
    if method == "standard":
        wanted = [f for c in columns for f in (F.avg(x[c]), F.stddev_pop(x[c]))]
    elif method == "minmax":
        wanted = [f for c in columns for f in (F.min(x[c]), F.max(x[c]) - F.min(x[c]))]
    else:
        raise ValueError(f"unknown scaling {method!r}")
    row = df.agg(*wanted).first()
    return {c: Scale(row[2 * i] or 0.0, row[2 * i + 1] or 0.0) for i, c in enumerate(columns)}


def apply_scale(df: DataFrame, scales: Mapping[str, Scale]) -> DataFrame:
    """Scale columns with stored parameters, as done at training and again at scoring."""
    return df.withColumns({c: (number(df, c) - F.lit(s.origin)) / F.lit(s.divisor) for c, s in scales.items()})


@dataclass
class Prepared:
    """Numeric columns made ready for distances: filled by the median, then standardised."""

    table: DataFrame
    raw: DataFrame
    scales: dict[str, Scale]
    fills: dict[str, float]
    n_filled: int
    columns: list[str] = field(default_factory=list)


def prepare_numeric(df: DataFrame, columns: Sequence[str]) -> Prepared:
    columns = list(columns)
    fills = fill_values(df, "median", columns)
    blanks = df.agg(*[F.count_if(present(df, c).isNull()) for c in columns]).first()
    raw = fill_missing(df, fills)
    scales = fit_scale(raw, columns, "standard")
    return Prepared(apply_scale(raw, scales), raw, scales, fills, sum(blanks), columns)
