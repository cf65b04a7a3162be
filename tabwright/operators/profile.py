"""What a table looks like: types, counts, spreads, shapes and relations of its columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import (
    as_rows,
    categorical_columns,
    number,
    numeric_columns,
    present,
    quoted,
    ratio,
)
from tabwright.functions.statistics import correlation, correlation_pairs, order_stats

# What counts as a number in text.
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
TEXT_LENGTH = 20
STRONG_PAIR = 0.9
WIDE_SCALE = 100


def text_number(value: Column) -> Column:
    """The number a text stands for, NULL when it is none."""
    return F.when(value.rlike(NUMBER_TEXT), value.try_cast("double"))


def distinct_values(df: DataFrame, name: str, approximate: bool = False) -> Column:
    """Distinct values of a column; missing counts as one more value."""
    value = present(df, name)
    counted = F.approx_count_distinct(value) if approximate else F.countDistinct(value)
    return counted + F.max(value.isNull().cast("long"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(name, n_unique) per column; missing counts as one more value.

    Exact counts go column by column in one job: each branch reads one column and shuffles its
    distinct values, where a joint count would carry every row once per column.
    """
    if approximate:
        counts = [distinct_values(df, c, True).alias(f"u{i}") for i, c in enumerate(columns)]
        rows = [F.struct(F.lit(c).alias("name"), F.col(f"u{i}").alias("n_unique")) for i, c in enumerate(columns)]
        return df.agg(*counts).select(as_rows(rows))
    out = None
    for c in columns:
        values = df.select(present(df, c).alias("v")).distinct()
        branch = values.agg(F.lit(c).alias("name"), F.count(F.lit(1)).alias("n_unique"))
        out = branch if out is None else out.unionByName(branch)
    return out


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, distinct, missing, min, max, mean and population deviation."""
    numbers = set(numeric_columns(df))
    aggregates, rows = [], []
    nothing = F.lit(None).cast("double")
    for i, name in enumerate(df.columns):
        aggregates.append(F.count_if(present(df, name).isNull()).alias(f"m{i}"))
        spread = [nothing] * 4
        if name in numbers:
            x = number(df, name)
            spread = [F.col(f"{kind}{i}") for kind in ("lo", "hi", "mean", "std")]
            aggregates += [
                f(x).alias(f"{kind}{i}")
                for f, kind in ((F.min, "lo"), (F.max, "hi"), (F.avg, "mean"), (F.stddev_pop, "std"))
            ]
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("name"),
                F.lit("numeric" if name in numbers else "categorical").alias("type"),
                F.col(f"m{i}").alias("n_missing"),
                *[s.alias(kind) for s, kind in zip(spread, ("min", "max", "mean", "std"), strict=True)],
            )
        )
    facts = df.agg(*aggregates).select(as_rows(rows))
    # one row per column of the table on both sides
    return facts.join(F.broadcast(distinct_counts(df, df.columns, approximate)), "name").select(
        "position", "name", "type", "n_unique", "n_missing", "min", "max", "mean", "std"
    )


def as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long table (name, value) of the named columns as text."""
    texts = df.select(*[present(df, c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], list(columns), "name", "value")


def sample_values(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    """The first n distinct values of each column in text order."""
    first = Window.partitionBy("name").orderBy("value")
    return (
        as_text(df, columns)
        .where(F.col("value").isNotNull())
        .distinct()
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= n)
        .groupBy("name")
        .agg(F.array_sort(F.collect_list("value")).alias("sample"))
    )


def column_typing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns typed by both rules: every value a number, or more than half of those present."""
    aggregates, rows = [], []
    for i, name in enumerate(columns):
        value = F.when(F.trim(F.col(quoted(name))) != "", F.col(quoted(name)))
        aggregates += [
            F.count(F.lit(1)).alias(f"n{i}"),
            F.count(value).alias(f"p{i}"),
            F.count(text_number(value)).alias(f"k{i}"),
        ]
        everything, held, numbers = F.col(f"n{i}"), F.col(f"p{i}"), F.col(f"k{i}")
        rows.append(
            F.struct(
                F.lit(name).alias("name"),
                held.alias("n_present"),
                numbers.alias("n_numbers"),
                F.when((numbers == everything) & (numbers > 0), "numeric").otherwise("categorical").alias("strict_type"),
                F.when(numbers > held * 0.5, "numeric").otherwise("categorical").alias("majority_type"),
            )
        )
    return df.agg(*aggregates).select(as_rows(rows))


def text_columns(df: DataFrame, min_length: float = TEXT_LENGTH) -> DataFrame:
    """Mean length of each non-numeric column and whether it is read as free text."""
    names = categorical_columns(df)
    sums = [F.avg(F.length(F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")))).alias(f"l{i}") for i, c in enumerate(names)]
    rows = [
        F.struct(
            F.lit(c).alias("name"),
            F.col(f"l{i}").alias("mean_length"),
            (F.col(f"l{i}") > min_length).alias("is_text"),
        )
        for i, c in enumerate(names)
    ]
    return df.agg(*sums).select(as_rows(rows))


def missing_cells(df: DataFrame) -> DataFrame:
    """Missing cells per column, with their share in percent."""
    counts = [F.count_if(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    rows = [
        F.struct(
            F.lit(c).alias("name"),
            F.col(f"m{i}").alias("n_missing"),
            F.round(ratio(F.col(f"m{i}"), F.col("n")) * 100, 1).alias("pct"),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.agg(F.count(F.lit(1)).alias("n"), *counts).select(as_rows(rows))


def completeness(df: DataFrame) -> DataFrame:
    """Share of cells that hold a value."""
    missing = sum((F.count_if(present(df, c).isNull()) for c in df.columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg(missing.alias("n_missing"), cells.alias("n_cells")).withColumn(
        "completeness", 1 - ratio(F.col("n_missing"), F.col("n_cells"))
    )


def _row_key(df: DataFrame) -> DataFrame:
    """Columns that decide row equality; texts travel as digests so that long ones stay off the shuffle."""
    return df.select(
        *[
            F.sha2(F.col(quoted(f.name)), 256).alias(f.name) if f.dataType.typeName() == "string" else F.col(quoted(f.name))
            for f in df.schema
        ]
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one: all rows less the distinct ones."""
    return (
        _row_key(df)
        .groupBy(*[quoted(c) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicates"),
        )
    )


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value, from min, max and the missing count alone."""
    aggregates, rows = [], []
    for i, name in enumerate(df.columns):
        value = present(df, name)
        aggregates += [
            F.min(value).alias(f"a{i}"),
            F.max(value).alias(f"b{i}"),
            F.count_if(value.isNull()).alias(f"m{i}"),
            F.count(value).alias(f"k{i}"),
        ]
        flat = (F.col(f"a{i}") == F.col(f"b{i}")) & (F.col(f"m{i}") == 0)
        rows.append(
            F.struct(F.lit(name).alias("name"), ((F.col(f"k{i}") == 0) | F.coalesce(flat, F.lit(False))).alias("constant"))
        )
    return df.agg(*aggregates).select(as_rows(rows)).where("constant").select("name")


def all_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def high_correlations(df: DataFrame, columns: Sequence[str] | None = None, limit: float = STRONG_PAIR) -> DataFrame:
    """Pairs of numeric columns whose correlation passes the limit, r to three places."""
    pairs = all_pairs(columns or numeric_columns(df))
    return (
        correlation_pairs(df, pairs)
        .where(F.abs("r") > limit)
        .select("x", "y", F.round("r", 3).alias("r"))
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long matrix (x, y, r): pairwise complete, 0 with fewer than three pairs or a constant side."""
    upper = correlation_pairs(df, [(a, b) for i, a in enumerate(columns) for b in columns[i:]])
    upper = upper.select("x", "y", F.when(F.col("n") < 3, 0.0).otherwise(F.col("r")).alias("r"))
    lower = upper.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "r")
    return upper.unionByName(lower)


def graded_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One pair's r with both gradings: by .8/.5/.3 and by .7/.3."""
    a, b = number(df, x), number(df, y)
    size = F.abs("r")
    return df.agg(F.count_if(a.isNotNull() & b.isNotNull()).alias("n"), correlation(a, b).alias("r")).select(
        F.lit(x).alias("x"),
        F.lit(y).alias("y"),
        "n",
        "r",
        F.when(size >= 0.8, "strong").when(size >= 0.5, "moderate").when(size >= 0.3, "weak").otherwise("very weak").alias("grade"),
        F.when(size > 0.7, "strong").when(size > 0.3, "moderate").otherwise("weak").alias("insight_grade"),
        F.when(F.col("r") >= 0, "positive").otherwise("negative").alias("direction"),
    )


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """The complete (x, y) pairs of two numeric columns."""
    return df.select(number(df, x).alias("x"), number(df, y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def scale_spread(df: DataFrame, columns: Sequence[str] | None = None, limit: float = WIDE_SCALE) -> DataFrame:
    """Largest over smallest non-zero range and whether it passes the limit."""
    columns = list(columns or numeric_columns(df))
    ranges = F.array(*[F.max(number(df, c)) - F.min(number(df, c)) for c in columns])
    return (
        df.agg(ranges.alias("ranges"))
        .select(F.filter("ranges", lambda r: r > 0).alias("ranges"))
        .select(
            F.size("ranges").cast("long").alias("n_ranges"),
            ratio(F.array_max("ranges"), F.array_min("ranges")).alias("ratio"),
        )
        .withColumn("scale_issue", (F.col("n_ranges") > 1) & (F.col("ratio") > limit))
    )


def target_check(df: DataFrame, target: str, numeric: bool | None = None) -> DataFrame:
    """Distinct values of a target, the task it suggests, its majority share and imbalance."""
    numeric = target in numeric_columns(df) if numeric is None else numeric
    counts = df.where(present(df, target).isNotNull()).groupBy(quoted(target)).agg(F.count(F.lit(1)).alias("n"))
    majority = F.round(ratio(F.max("n"), F.sum("n")) * 100, 1)
    return counts.agg(
        F.lit(target).alias("target"),
        F.count(F.lit(1)).alias("n_unique"),
        F.lit("regression" if numeric else "classification").alias("task"),
        (F.lit(None).cast("double") if numeric else majority).alias("majority_pct"),
        (F.lit(False) if numeric else ratio(F.max("n"), F.sum("n")) > 0.8).alias("imbalanced"),
    )


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """Classification for text, two values or under 5 % distinct; regression otherwise."""
    numeric = target in numeric_columns(df)
    share = ratio(F.col("n_unique"), F.col("n_rows"))
    rule = (
        F.when(F.lit(not numeric) | (F.col("n_unique") == 2) | (share < 0.05), "classification").otherwise("regression")
    )
    return df.agg(distinct_values(df, target).alias("n_unique"), F.count(F.lit(1)).alias("n_rows")).withColumn(
        "problem_type", rule
    )


def five_numbers(df: DataFrame, name: str) -> DataFrame:
    """Count, mean, true median, population deviation, minimum and maximum of one column.

    The median is the mean of the two middle order statistics.
    """
    x = number(df, name)
    out = df.agg(
        F.lit(name).alias("name"),
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    return out.withColumn("median", F.lit(true_median(df, name)))


def true_median(df: DataFrame, name: str) -> float | None:
    n = df.select(F.count(number(df, name))).first()[0]
    if n == 0:
        return None
    middle = ((n // 2 - 1 + 0.5) / n, (n // 2 + 0.5) / n) if n % 2 == 0 else ((n // 2 + 0.5) / n,)
    values = order_stats(df, {name: middle})[name]
    return sum(values.values()) / len(values)


def histogram(df: DataFrame, name: str) -> DataFrame:
    """Equal-width bins, between 5 and 20 by the root of the count; one bin for a constant column."""
    x = number(df, name)
    n, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if n == 0 or low == high:
        bins, width = (0 if n == 0 else 1), 0.0
    else:
        bins = min(20, max(5, math.ceil(math.sqrt(n))))
        width = (high - low) / bins
    slot = F.least(F.floor((x - low) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
    counts = df.where(x.isNotNull()).groupBy(slot.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(low) + F.col("id") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("id") + 1) * F.lit(width)).alias("high"),
    )
    return edges.join(F.broadcast(counts), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def category_counts(df: DataFrame, name: str) -> DataFrame:
    """Rows per category, with the rare mark below max(2, 2 % of all rows)."""
    rows = df.count()
    return (
        df.where(present(df, name).isNotNull())
        .groupBy(F.col(quoted(name)).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("rare", F.col("n") < F.lit(max(2.0, rows * 0.02)))
    )


def scenario_defaults(df: DataFrame, columns: Sequence[str], max_categories: int = 30) -> DataFrame:
    """Per feature: min, max, mean, median and the default a scenario starts from.

    Numbers start at the median; categories at the first in order. The first 30 categories are
    listed, as the form shows them.
    """
    numbers = [c for c in columns if c in numeric_columns(df)]
    words = [c for c in columns if c not in numbers]
    medians = order_stats(df, {c: (0.5,) for c in numbers})
    nothing = F.lit(None).cast("double")
    out = None
    if numbers:
        aggregates, rows = [], []
        for i, c in enumerate(numbers):
            x = number(df, c)
            aggregates += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.avg(x).alias(f"c{i}")]
            median = medians[c][0.5]
            rows.append(
                F.struct(
                    F.lit(c).alias("feature"),
                    F.lit("numeric").alias("type"),
                    F.col(f"a{i}").alias("min"),
                    F.col(f"b{i}").alias("max"),
                    F.col(f"c{i}").alias("mean"),
                    F.lit(median).alias("median"),
                    F.lit(f"{median:.2f}" if median is not None else "0").alias("default"),
                    F.lit(None).cast("string").alias("categories"),
                )
            )
        out = df.agg(*aggregates).select(as_rows(rows))
    if words:
        listed = sample_values(df, words, max_categories).select(
            F.col("name").alias("feature"),
            F.lit("categorical").alias("type"),
            *[nothing.alias(k) for k in ("min", "max", "mean", "median")],
            F.element_at("sample", 1).alias("default"),
            F.array_join("sample", "|").alias("categories"),
        )
        out = listed if out is None else out.unionByName(listed)
    return out
