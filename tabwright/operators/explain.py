"""Why a model predicts what it predicts: attributions, surrogates, effects.

`score` is any function that adds a `prediction` column to a table with the feature columns: a
fitted learner, a pipeline, a formula.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import number, quoted
from tabwright.functions.sampling import SEED, pick
from tabwright.functions.vectors import squared_distance
from tabwright.operators.clean import fit_scale
from tabwright.operators.learners import LinearModel, feature_columns

Score = Callable[[DataFrame], DataFrame]

# Rows explained and rows they are compared with, by report.
SAMPLES = {"global": (60, 60), "points": (80, 50), "row": (1, 80), "dependence": (120, 50)}
TINY = 1e-10


def _rows(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(k) for k in keys], *[number(df, f).alias(f) for f in features])


def linear_attributions(df: DataFrame, keys: Sequence[str], model: LinearModel, background: DataFrame | None = None) -> DataFrame:
    """(keys, feature, value, attribution, base, prediction) for every row of a table.

    For a linear model the mean over the background of f(x) - f(x with one feature replaced) is
    weight * (value - background mean), and these already add up to f(x) - base, so one scan
    with the means as constants gives what sampling can only approach.
    """
    background = df if background is None else background
    scales = fit_scale(background, model.features, "standard")
    weights = dict(zip(model.features, model.coefficients[1:], strict=True))
    base = model.coefficients[0] + sum(weights[f] * scales[f].origin for f in model.features)
    items = [
        F.struct(
            F.lit(f).alias("feature"),
            number(df, f).alias("value"),
            (F.lit(weights[f]) * (number(df, f) - F.lit(scales[f].origin))).alias("attribution"),
        )
        for f in model.features
    ]
    return df.select(
        *[quoted(k) for k in keys], F.lit(base).alias("base"), model.predict().alias("prediction"), F.inline(F.array(*items))
    )


def attributions(
    instances: DataFrame, keys: Sequence[str], background: DataFrame, features: Sequence[str], score: Score
) -> DataFrame:
    """(keys, feature, value, attribution, base, prediction) for any model.

    Every instance is repeated with each feature taken from each background row, all of it scored
    in one pass, averaged per (instance, feature) and scaled to add up to prediction - base. The
    background is a sample of a few dozen rows, which the tasks carry; instances can be many.
    """
    names = list(features)
    bg = _rows(background, [], names)
    base = float(score(bg).agg(F.avg("prediction")).first()[0])
    sample = bg.toPandas().to_numpy(dtype=float)
    rows = _rows(instances, keys, names)
    key_fields = ", ".join(f"{quoted(k)} {rows.schema[k].dataType.simpleString()}" for k in keys)
    feature_fields = ", ".join(f"{quoted(f)} double" for f in names)
    width, depth = len(names), len(sample)

    def replaced(frames):
        for frame in frames:
            for start in range(0, len(frame), 200):
                part = frame.iloc[start : start + 200]
                matrix = part[names].to_numpy(dtype=float)
                grid = np.repeat(matrix, width * depth, axis=0).reshape(len(part), width, depth, width)
                for j in range(width):
                    grid[:, j, :, j] = sample[:, j]
                out = pd.DataFrame(grid.reshape(-1, width), columns=names)
                for k in keys:
                    out[k] = np.repeat(part[k].to_numpy(), width * depth)
                out["_j"] = np.tile(np.repeat(np.arange(width), depth), len(part)).astype("int32")
                yield out

    mixed = rows.mapInPandas(replaced, f"{key_fields}, {feature_fields}, _j int")
    means = score(mixed).groupBy(*keys, "_j").agg(F.avg("prediction").alias("_mean"))
    values = [F.struct(F.lit(j).alias("_j"), F.lit(f).alias("feature"), F.col(quoted(f)).alias("value")) for j, f in enumerate(names)]
    own = score(rows).select(*keys, F.col("prediction").cast("double").alias("prediction"), F.inline(F.array(*values)))
    both = own.join(means, [*keys, "_j"]).withColumn("_raw", F.col("prediction") - F.col("_mean"))
    total = F.sum("_raw").over(Window.partitionBy(*keys))
    gap = F.col("prediction") - F.lit(base)
    attribution = F.when(F.abs(total) > TINY, F.col("_raw") * gap / total).otherwise(F.col("_raw"))
    return both.select(*keys, "feature", "value", attribution.alias("attribution"), F.lit(base).alias("base"), "prediction")


def sampled_attributions(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], score: Score, report: str = "global", seed: int = SEED
) -> DataFrame:
    """`attributions` of a sample of rows against a sampled background, sized by the kind of report."""
    n_rows, n_background = SAMPLES[report]
    return attributions(pick(df, list(keys), n_rows, seed), keys, pick(df, list(keys), n_background, seed + 1), features, score)


def global_importance(attributed: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature."""
    return attributed.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance")).orderBy(F.desc("importance"), "feature")


def normalized_points(attributed: DataFrame, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Attributions with the value's place in the range of its column, .5 for a constant one."""
    ranges = fit_scale(df, list(features), "minmax")
    place = F.lit(0.5)
    for f, s in ranges.items():
        if s.spread:
            place = F.when(F.col("feature") == f, (F.col("value") - F.lit(s.origin)) / F.lit(s.spread)).otherwise(place)
    return attributed.withColumn("normalized", place)


def dependence(attributed: DataFrame, feature: str) -> DataFrame:
    """Attribution against value for one feature."""
    return attributed.where(F.col("feature") == feature).select(F.col("value"), F.col("attribution"))


def direction_summary(attributed: DataFrame) -> DataFrame:
    """Mean positive and mean negative attribution per feature and which is larger."""
    a = F.col("attribution")
    out = attributed.groupBy("feature").agg(
        F.coalesce(F.avg(F.when(a >= 0, a)), F.lit(0.0)).alias("positive"),
        F.coalesce(F.avg(F.when(a < 0, a)), F.lit(0.0)).alias("negative"),
    )
    return out.withColumn("direction", F.when(F.abs("positive") > F.abs("negative"), "increase").otherwise("decrease"))


def effect_ranges(points: DataFrame, top: int = 5) -> DataFrame:
    """Mean attribution of high (> .6) and low (< .4) values and which way to go, for the top features."""
    a, place = F.col("attribution"), F.col("normalized")
    out = points.groupBy("feature").agg(
        F.coalesce(F.avg(F.when(place > 0.6, a)), F.lit(0.0)).alias("high"),
        F.coalesce(F.avg(F.when(place < 0.4, a)), F.lit(0.0)).alias("low"),
        F.avg(F.abs(a)).alias("importance"),
    )
    return out.withColumn("advice", F.when(F.col("high") > F.col("low"), "higher").otherwise("lower")).orderBy(
        F.desc("importance"), "feature"
    ).limit(top)


def waterfall(attributed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attributions of a row stacked from the base, largest first: where each bar starts and how long it is."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs("attribution")), "feature")
    after = F.col("base") + F.sum("attribution").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.col("_after") - F.col("attribution")
    return attributed.withColumn("_after", after).select(
        *keys,
        "feature",
        F.row_number().over(order).alias("place"),
        "attribution",
        F.least(before, "_after").alias("offset"),
        F.abs("attribution").alias("width"),
    )


def force(attributed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attributions of a row split by sign: (keys, side, total, features largest first)."""
    side = F.when(F.col("attribution") >= 0, "positive").otherwise("negative")
    size = F.abs("attribution")
    listed = F.array_sort(F.collect_list(F.struct((-size).alias("s"), F.col("feature"))))
    return attributed.groupBy(*keys, side.alias("side")).agg(
        F.sum(size).alias("total"), F.array_join(F.transform(listed, lambda x: x["feature"]), "|").alias("features")
    )


def value_and_prediction(df: DataFrame, features: Sequence[str], score: Score) -> DataFrame:
    """(feature, value, prediction) of every row and feature."""
    scored = score(df)
    items = [F.struct(F.lit(f).alias("feature"), number(df, f).alias("value")) for f in features]
    return scored.select("prediction", F.inline(F.array(*items)))


def _normal(*keys: Column) -> Column:
    """A standard normal number fixed by the keys, so that a task run twice draws the same."""
    scale = float(1 << 53)

    def unit(seed: int) -> Column:
        bits = F.pmod(F.xxhash64(F.lit(SEED + seed), *keys), F.lit(1 << 53))
        return (bits.cast("double") + 0.5) / scale

    return F.sqrt(-2.0 * F.ln(unit(1))) * F.cos(2 * math.pi * unit(2))


def _perturbed(instances: DataFrame, keys: Sequence[str], features: Sequence[str], spreads, draws: int, strength: float) -> DataFrame:
    """Each instance (draw 0) and its noisy copies."""
    rows = instances.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    moved = {}
    for j, f in enumerate(features):
        noise = _normal(*[F.col(k) for k in keys], F.col("_draw"), F.lit(j)) * strength * F.lit(spreads[f])
        moved[f] = F.col(quoted(f)) + F.when(F.col("_draw") == 0, 0.0).otherwise(noise)
        moved[f"_own{j}"] = F.col(quoted(f))
    return rows.select(*keys, "_draw", *[c.alias(n) for n, c in moved.items()])


def _spreads(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    return {f: s.divisor for f, s in fit_scale(df, list(features), "standard").items()}


def local_surrogate(
    instances: DataFrame, keys: Sequence[str], df: DataFrame, features: Sequence[str], score: Score, draws: int = 300, penalty: float = 0.01
) -> DataFrame:
    """(keys, feature, weight, contribution, intercept, prediction) of a weighted ridge around each instance.

    The products each fit needs are summed per instance by Spark; what is left to solve is one
    small system per instance.
    """
    names, p = list(features), len(features)
    spreads = _spreads(df, names)
    rows = _perturbed(_rows(instances, keys, names), keys, names, spreads, draws, 0.5)
    far = sum(
        (((F.col(quoted(f)) - F.col(f"_own{j}")) / spreads[f]) ** 2 for j, f in enumerate(names)), F.lit(0.0)
    ) / p
    kernel = 2 * (math.sqrt(p) * 0.75) ** 2
    scored = score(rows.withColumn("_w", F.exp(-far / kernel)))
    x, y, w = feature_columns(names), F.col("prediction").cast("double"), F.col("_w")
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    own = F.col("_draw") == 0
    sums = scored.groupBy(*keys).agg(
        F.array(*[F.sum(w * x[i] * x[j]) for i, j in cells]).alias("gram"),
        F.array(*[F.sum(w * x[i] * y) for i in range(p)]).alias("moment"),
        F.array(*[F.max(F.when(own, F.col(f"_own{j}"))) for j in range(p)]).alias("own"),
        F.max(F.when(own, y)).alias("prediction"),
    )
    key_fields = ", ".join(f"{quoted(k)} {sums.schema[k].dataType.simpleString()}" for k in keys)

    def solve(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                gram = np.zeros((p, p))
                for (i, j), value in zip(cells, row.gram, strict=True):
                    gram[i, j] = gram[j, i] = value
                beta = np.linalg.solve(gram + penalty * np.eye(p), np.array(row.moment))
                point = np.array(row.own)
                intercept = row.prediction - float(point @ beta)
                key = [getattr(row, k) for k in keys]
                out += [(*key, f, b, b * v, intercept, row.prediction) for f, b, v in zip(names, beta, point, strict=True)]
            yield pd.DataFrame(out, columns=[*keys, "feature", "weight", "contribution", "intercept", "prediction"])

    return sums.mapInPandas(
        solve, f"{key_fields}, feature string, weight double, contribution double, intercept double, prediction double"
    )


def class_shares(
    instances: DataFrame, keys: Sequence[str], df: DataFrame, features: Sequence[str], score: Score, draws: int = 200
) -> DataFrame:
    """(keys, class, share) of the predicted classes of an instance and its noisy copies."""
    names = list(features)
    rows = _perturbed(_rows(instances, keys, names), keys, names, _spreads(df, names), draws, 0.3)
    found = score(rows).groupBy(*keys, F.round("prediction").alias("class")).agg(F.count(F.lit(1)).alias("_n"))
    return found.select(*keys, "class", (F.col("_n") / F.lit(float(draws + 1))).alias("share"))


def nearest_center_score(features: Sequence[str], centers: Sequence[Sequence[float]]) -> Score:
    """The nearest center's number as a prediction, to explain a clustering."""
    x = feature_columns(features)
    gaps = [F.struct(squared_distance(x, c).alias("d"), F.lit(float(i)).alias("c")) for i, c in enumerate(centers)]
    prediction = F.array_min(F.array(*gaps))["c"]
    return lambda df: df.withColumn("prediction", prediction)
