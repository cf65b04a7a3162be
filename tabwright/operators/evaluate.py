"""How good predictions are, and how models compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import clamp, ratio

# Cut-offs below which a metric is rated, best rating last.
GRADES = {
    "r2": ((0.3, "poor"), (0.5, "fair"), (0.9, "good"), (None, "excellent")),
    "accuracy": ((0.5, "poor"), (0.7, "fair"), (0.9, "good"), (None, "excellent")),
    "f1": ((0.5, "poor"), (0.7, "fair"), (0.9, "good"), (None, "excellent")),
    "precision": ((0.5, "poor"), (0.7, "fair"), (0.9, "good"), (None, "excellent")),
    "recall": ((0.5, "poor"), (0.7, "fair"), (0.9, "good"), (None, "excellent")),
    "cv_score": ((0.5, "poor"), (0.7, "fair"), (0.9, "good"), (None, "excellent")),
    "silhouette": ((0.0, "poor"), (0.25, "fair"), (0.75, "good"), (None, "excellent")),
    "calinski_harabasz": ((50.0, "fair"), (200.0, "good"), (None, "excellent")),
}
# The same for a metric where less is better.
GRADES_DOWN = {"davies_bouldin": ((2.0, "poor"), (1.0, "fair"), (0.5, "good"), (None, "excellent"))}
SCORE_BANDS = ((0.9, "Excellent"), (0.7, "Good"), (0.5, "Fair"), (None, "Needs Work"))
SHARE_METRICS = ("accuracy", "precision", "recall", "f1", "r2")


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """r2 (0 without variance), mae, mse and rmse in one scan."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    gap = y - p
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.var_pop(y).alias("_v"),
        F.avg(F.abs(gap)).alias("mae"),
        F.avg(gap * gap).alias("mse"),
    )
    r2 = F.when(F.col("_v") > 0, 1 - F.try_divide("mse", "_v")).otherwise(0.0)
    return out.withColumn("rmse", F.sqrt("mse")).withColumn("r2", r2).drop("_v")


def confusion(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Long confusion matrix: rows per (actual, predicted)."""
    return df.groupBy(*by, F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def per_class(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, f1 and support of every class seen on either side."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("actual_n"), F.lit(0).cast("long").alias("predicted_n"), hit.cast("long").alias("hits")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("actual_n"), F.col("n").alias("predicted_n"), F.lit(0).cast("long").alias("hits")),
    )
    sums = (
        matrix.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("actual_n", "predicted_n", "hits")])
    )
    precision, recall = ratio(F.col("hits"), F.col("predicted_n")), ratio(F.col("hits"), F.col("actual_n"))
    return sums.select(
        *by,
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        F.col("actual_n").alias("support"),
        F.col("hits"),
    )


def classification_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, macro precision and recall, f1 of those two, and f1 weighted by support."""
    classes = per_class(confusion(df, label, prediction, by), by)
    out = classes.groupBy(*by).agg(
        F.sum("support").alias("n"),
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1_macro", ratio(2 * p * r, p + r))


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.withColumn("residual", F.col(label) - F.col(prediction))


def residual_summary(df: DataFrame, label: str, prediction: str, factor: float = 0.5) -> DataFrame:
    """Mean, population deviation and mean size of the residuals; Good when the mean is small against the deviation."""
    gap = F.col(label) - F.col(prediction)
    out = df.agg(F.avg(gap).alias("mean"), F.stddev_pop(gap).alias("std"), F.avg(F.abs(gap)).alias("mean_abs"))
    return out.withColumn(
        "predictive_power", F.when(F.abs("mean") < F.col("std") * factor, "Good").otherwise("Low")
    )


def grade(metric: Column, value: Column) -> Column:
    """Rating of a metric value; NULL for metrics without one."""
    ladder = None

    def ladder_for(bands, below):
        rating = None
        for cut, name in bands:
            if cut is None:
                return rating.otherwise(name)
            test = value < cut if below else value > cut
            rating = F.when(test, name) if rating is None else rating.when(test, name)
        return rating

    for below, table in ((True, GRADES), (False, GRADES_DOWN)):
        for name, bands in table.items():
            test = (metric == name) & value.isNotNull() & (F.abs(value) < float("inf"))
            rating = ladder_for(bands, below)
            ladder = F.when(test, rating) if ladder is None else ladder.when(test, rating)
    return ladder


def score_band(score: Column, higher_better: bool = True) -> Column:
    value = score if higher_better else F.greatest(F.lit(0.0), 1 - score)
    out = None
    for cut, name in SCORE_BANDS:
        if cut is None:
            return out.otherwise(name)
        out = F.when(value >= cut, name) if out is None else out.when(value >= cut, name)
    return out


def train_test_gap(train: DataFrame, test: DataFrame, keys: Sequence[str], limit: float = 0.15) -> DataFrame:
    """Train minus test per model and metric from two long tables (keys, metric, value).

    Share metrics count in points and are marked when the gap passes the limit.
    """
    both = train.withColumnRenamed("value", "train").join(
        test.withColumnRenamed("value", "test"), [*keys, "metric"]
    )
    share = F.col("metric").isin(*SHARE_METRICS)
    gap = F.col("train") - F.col("test")
    return both.withColumn("gap", F.when(share, gap * 100).otherwise(gap)).withColumn(
        "overfit", share & (gap > limit)
    )


def metric_rows(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics as rows (keys, metric, value)."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return df.select(*keys, F.inline(F.array(*pairs)))


def compare_models(models: DataFrame, classification: bool) -> DataFrame:
    """Weighted score of each model, which one wins, and the spread between best and worst.

    `models` has model_id and its metrics. The runner-up is chosen by its own rule: the weighted
    score for classification, r2 for regression. Between equal scores the smaller id wins.
    """

    def metric(name):
        return F.coalesce(F.col(name), F.lit(0.0))

    if classification:
        score = (
            metric("f1") * 0.4 + metric("accuracy") * 0.3 + metric("precision") * 0.15 + metric("recall") * 0.15
        )
        second, plain = score, metric("accuracy")
    else:
        score = (
            metric("r2") * 0.5
            + (1 - F.least(F.lit(1.0), metric("mae") / 100)) * 0.25
            + (1 - F.least(F.lit(1.0), metric("rmse") / 100)) * 0.25
        )
        second, plain = metric("r2"), metric("r2")
    scored = models.select("model_id", score.alias("score"), second.alias("_second"), plain.alias("_plain"))

    def leader(value):
        return F.min(F.struct((-F.col(value)).alias("down"), "model_id"))["model_id"]

    winner, best, worst, n = scored.agg(
        leader("score"), F.max("_plain"), F.min("_plain"), F.count(F.lit(1))
    ).first()
    role = F.when(F.col("model_id") == F.lit(winner), "winner")
    if n > 2:
        runner_up = scored.where(F.col("model_id") != F.lit(winner)).agg(leader("_second")).first()[0]
        role = role.when(F.col("model_id") == F.lit(runner_up), "runner-up")
    spread = best - worst if n else None
    return scored.select("model_id", "score", role.otherwise("other").alias("role"), F.lit(spread).alias("spread"))


def radar(models: DataFrame, metrics: Sequence[str], errors: Sequence[str] = ("mae", "rmse")) -> DataFrame:
    """Metrics on a common 0-1 scale; errors count against the worst model."""
    worst = models.agg(*[F.coalesce(F.max(m), F.lit(0.0)).alias(m) for m in metrics if m in errors]).first() if any(
        m in errors for m in metrics
    ) else None
    scaled = {}
    for m in metrics:
        value = F.coalesce(F.col(m), F.lit(0.0))
        if m in errors and worst[m] > 0:
            value = 1 - value / F.lit(worst[m])
        scaled[m] = clamp(value, 0.0, 1.0)
    return metric_rows(models.select("model_id", *[v.alias(m) for m, v in scaled.items()]), ["model_id"], metrics)


def importance_table(importances: DataFrame, models: Sequence[str], per_model: int = 8, kept: int = 10) -> DataFrame:
    """Feature importance in percent side by side, 0 where a model lacks the feature.

    `importances` has model_id, feature, importance. Features come from
    each model's first eight, and the first ten of those by the best place they reach.
    """
    place = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("importance"), "feature"))
    chosen = (
        importances.withColumn("_place", place)
        .where(F.col("_place") <= per_model)
        .groupBy("feature")
        .agg(F.min("_place").alias("_best"), F.max("importance").alias("_top"))
        .orderBy("_best", F.desc("_top"), "feature")
        .limit(kept)
    )
    return (
        importances.join(F.broadcast(chosen.select("feature")), "feature", "left_semi")
        .groupBy("feature")
        .pivot("model_id", list(models))
        .agg(F.round(F.first("importance") * 100, 1))
        .fillna(0.0, subset=list(models))
    )


def fold_scores(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of fold scores; a failed fold counts as 0."""
    value = F.coalesce(F.col("score"), F.lit(0.0))
    return scores.groupBy(*keys).agg(F.avg(value).alias("cv_mean"), F.stddev_pop(value).alias("cv_std"))


def fold_number(key: Column, k: int = 5) -> Column:
    """Fold of a row by its integer key."""
    return F.pmod(key, F.lit(k))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5) -> DataFrame | None:
    """`fold` per row, dealt out class by class; never more folds than the smallest class, never under 2.

    None with fewer than four rows. Rows are numbered in slices, so a huge class is not one task.
    """
    from tabwright.functions.ranking import numbered

    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.sum("n")).first()
    if not counts[1] or counts[1] < 4:
        return None
    folds = min(k, counts[1] // 2)
    if counts[0] < folds:
        folds = max(2, counts[0])
    out = numbered(df, [(key, True)], [label], "_place")
    return out.withColumn("fold", F.pmod(F.col("_place") - 1, F.lit(folds))).drop("_place")
