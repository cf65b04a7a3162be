"""Scoring tables, scenarios and how far to trust a score."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import number, present, quoted, ratio
from tabwright.functions.statistics import order_stats
from tabwright.operators.features import label_text

# Confidence below which a level is given.
LEVELS = {"probability": (70, 85), "completeness": (50, 75)}
# Share of active text features below which a confidence is given.
TEXT_DENSITY = ((0.05, 30.0, "Low"), (0.15, 65.0, "Medium"), (None, 88.0, "High"))


def decode(df: DataFrame, labels: Sequence[str] | None, output: str = "prediction") -> DataFrame:
    """Predicted index back to its label."""
    return df if labels is None else df.withColumn(output, label_text(F.col(output), labels))


def clamp_non_negative(df: DataFrame, target_min: float | None, column: str = "prediction") -> DataFrame:
    """Predictions below 0 become 0 when the target never was below 0 in training."""
    if target_min is None or target_min < 0:
        return df
    return df.withColumn(column, F.greatest(F.lit(0.0), F.col(column)))


def flag_empty_input(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Marks rows whose every model input is blank."""
    blank = F.lit(True)
    for name in features:
        value = present(df, name)
        if df.schema[name].dataType.typeName() == "string":
            value = F.when(value != "", value)
        blank = blank & value.isNull()
    return df.withColumn("input_empty", blank)


def class_probabilities(df: DataFrame, column: str = "probability", output: str = "probabilities") -> DataFrame:
    """Probability vector as an array."""
    return df.withColumn(output, vector_to_array(column))


def _level(confidence: Column, kind: str) -> Column:
    low, medium = LEVELS[kind]
    return F.when(confidence < low, "Low").when(confidence < medium, "Medium").otherwise("High")


def class_confidence(df: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Largest class probability in percent and its level."""
    confidence = F.array_max(probabilities) * 100
    return df.withColumn("confidence", confidence).withColumn("confidence_level", _level(confidence, "probability"))


def input_confidence(df: DataFrame, features: Sequence[str], text_features: Sequence[str] = ()) -> DataFrame:
    """How complete a row's inputs are: share of non-zero features, or density of its text features."""

    def active(names, test):
        return sum((F.when(test(F.coalesce(number(df, n), F.lit(0.0))), 1).otherwise(0) for n in names), F.lit(0))

    if text_features:
        density = active(text_features, lambda v: v > 0) / len(text_features)
        confidence, level = None, None
        for cut, points, name in TEXT_DENSITY:
            if cut is None:
                confidence, level = confidence.otherwise(points), level.otherwise(name)
            elif confidence is None:
                confidence, level = F.when(density < cut, points), F.when(density < cut, name)
            else:
                confidence, level = confidence.when(density < cut, points), level.when(density < cut, name)
    else:
        confidence = active(features, lambda v: v != 0) / len(features) * 100
        level = _level(confidence, "completeness")
    return df.withColumn("confidence", confidence).withColumn("confidence_level", level)


def worst_level(df: DataFrame) -> DataFrame:
    """The lowest level over all scored rows."""
    order = F.when(F.col("confidence_level") == "Low", 0).when(F.col("confidence_level") == "Medium", 1).otherwise(2)
    return df.agg(F.min_by("confidence_level", order).alias("confidence_level"), F.min("confidence").alias("confidence"))


def compare_scenarios(
    df: DataFrame, keys: Sequence[str], changes: Mapping[str, Column], score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Every row scored as it is and with the changes: both predictions, difference, percent, what changed.

    Both scenarios are scored in one pass and meet again on the key.
    """
    names = list(changes)
    as_is = df.withColumn("scenario", F.lit("baseline"))
    changed = df.withColumns({n: F.coalesce(c, F.col(quoted(n))) for n, c in changes.items()}).withColumn(
        "scenario", F.lit("modified")
    )
    scored = score(as_is.unionByName(changed))
    pick = {s: F.col("scenario") == s for s in ("baseline", "modified")}
    both = scored.groupBy(*keys).agg(
        *[F.max(F.when(test, F.col("prediction"))).alias(s) for s, test in pick.items()],
        *[F.max(F.when(test, F.col(quoted(n)))).alias(f"{s}_{i}") for i, n in enumerate(names) for s, test in pick.items()],
    )
    touched = [F.when(~F.col(f"baseline_{i}").eqNullSafe(F.col(f"modified_{i}")), F.lit(n)) for i, n in enumerate(names)]
    difference = F.col("modified") - F.col("baseline")
    return both.select(
        *keys,
        "baseline",
        "modified",
        difference.alias("difference"),
        (ratio(difference, F.abs("baseline")) * 100).alias("pct_change"),
        F.concat_ws("|", *touched).alias("changed"),
    )


def row_suggestions(df: DataFrame, key: str, prediction: str = "prediction") -> DataFrame:
    """Rows worth explaining: highest, lowest and median prediction; the smallest key on a tie."""
    middle = order_stats(df, {prediction: (0.5,)})[prediction][0.5]
    value, order = F.col(prediction), -F.col(key)
    row = F.struct(F.col(key).alias("key"), value.alias("prediction"))
    chosen = df.agg(
        F.max_by(row, F.struct(value, order.alias("k"))).alias("highest"),
        F.min_by(row, F.struct(value, F.col(key))).alias("lowest"),
        F.min_by(row, F.when(value == F.lit(middle), F.col(key))).alias("median"),
    )
    picks = [
        F.struct(F.lit(n).alias("pick"), F.col(n)["key"].alias("key"), F.col(n)["prediction"].alias("prediction"))
        for n in ("highest", "lowest", "median")
    ]
    return chosen.select(F.inline(F.array(*picks)))
