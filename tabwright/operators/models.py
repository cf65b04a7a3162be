"""Training: Spark's own learners, cross-validation, tuning and the ranked candidates."""

from __future__ import annotations

import statistics
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product
from random import Random
from typing import Any

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import ArithmeticException, IllegalArgumentException
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import long_key, quoted
from tabwright.functions.sampling import SEED, unit_hash
from tabwright.operators import descent, fold_products, histogram_trees, learners
from tabwright.operators.evaluate import classification_metrics, regression_metrics, stratified_folds
from tabwright.session import ensure_checkpoint_dir, side_by_side

# Tunable parameters as (lowest, highest, step, usual value).
TUNABLE = {
    "linear_regression": {"lambda": (0.0001, 10, 0.01, 0.001)},
    "ridge_regression": {"lambda": (0.01, 10, 0.1, 1.0)},
    "logistic_regression": {
        "learningRate": (0.001, 0.5, 0.001, 0.01), "epochs": (50, 500, 50, 200), "lambda": (0.001, 10, 0.01, 0.01),
    },
    "decision_tree": {"maxDepth": (2, 25, 1, 10), "minSamples": (2, 30, 1, 2)},
    "random_forest": {"nTrees": (3, 50, 1, 10), "maxDepth": (2, 15, 1, 8)},
    "gradient_boosting": {"nTrees": (5, 100, 5, 30), "learningRate": (0.01, 0.5, 0.01, 0.1), "maxDepth": (2, 10, 1, 4)},
    "knn": {"k": (1, 30, 1, 5)},
    "svm": {"C": (0.01, 100, 0.5, 1.0), "learningRate": (0.001, 0.1, 0.001, 0.01), "epochs": (50, 500, 50, 200)},
    "naive_bayes": {"smoothing": (0.0001, 1.0, 0.0001, 0.001)},
}
# Learners tried when none is named.
CANDIDATES = {
    False: ("linear_regression", "ridge_regression", "decision_tree", "random_forest", "gradient_boosting"),
    True: ("logistic_regression", "decision_tree", "random_forest", "knn", "svm", "naive_bayes"),
}


def cross_validate(
    df: DataFrame,
    fold: str,
    folds: int,
    fit: Callable[[DataFrame], Column],
    classification: bool,
    label: str = "label",
) -> DataFrame:
    """(fold, score) where `fit` takes training rows and returns the prediction expression."""
    out = None
    for number in range(folds):
        prediction = fit(df.where(F.col(fold) != number))
        held_out = df.where(F.col(fold) == number).withColumn("prediction", prediction)
        measured = (classification_metrics if classification else regression_metrics)(held_out, label, "prediction")
        score = measured.select(
            F.lit(number).alias("fold"), F.col("accuracy" if classification else "r2").alias("score")
        )
        out = score if out is None else out.unionByName(score)
    return out


@dataclass
class Fitted:
    """A trained learner: how it scores a table and what it weighs."""

    algorithm: str
    features: list[str]
    score: Callable[[DataFrame], DataFrame]
    importance: list[tuple[str, float]] = field(default_factory=list)
    model: Any = None

    def predict(self, df: DataFrame) -> DataFrame:
        """The table with a `prediction` column."""
        return self.score(df)


def _top_importance(names: Sequence[str], weights: Sequence[float], top: int = 10) -> list[tuple[str, float]]:
    """Shares of the weights, largest first, without zeros."""
    whole = sum(weights)
    if not whole:
        return []
    shares = [(name, float(w) / whole) for name, w in zip(names, weights, strict=True) if w > 0]
    return sorted(shares, key=lambda item: (-item[1], item[0]))[:top]


# Learners whose folds and penalties follow from sums of products, with their usual penalty.
CLOSED = {"linear_regression": 0.001, "ridge_regression": 1.0}


def _weights(model: Any, size: int) -> list[float]:
    """Impurity importance of trees, absolute weights of linear models, summed over classes."""
    if hasattr(model, "models"):
        parts = [_weights(m, size) for m in model.models]
        return [sum(p[i] for p in parts) for i in range(size)]
    if hasattr(model, "featureImportances"):
        return [float(v) for v in model.featureImportances.toArray()]
    if hasattr(model, "coefficientMatrix"):
        return [float(v) for v in abs(model.coefficientMatrix.toArray()).sum(axis=0)]
    if hasattr(model, "coefficients"):
        return [float(v) for v in abs(model.coefficients.toArray())]
    return []


def depth_for(rows: int, deepest: int) -> int:
    """Tree depth that grows with the table, between 3 and `deepest`."""
    return min(deepest, max(3, max(rows, 1).bit_length() - 1))


# Learners by this library's own histograms: nodes as a table, importance by node counts.
HISTOGRAM = ("histogram_tree", "histogram_forest", "histogram_boosting")


def estimator(
    algorithm: str, classification: bool, rows: int, classes: int = 2, params: Mapping[str, float] | None = None
):
    """Spark's learner for an algorithm with the usual settings, or the given ones.

    Spark's optimiser has no learning rate for logistic and support-vector models; `fit` takes
    gradient steps instead where one is given.
    """
    p = dict(params or {})
    columns = {"featuresCol": "features", "labelCol": "label"}
    tree = {
        **columns,
        "maxDepth": int(p.get("maxDepth", depth_for(rows, 15 if algorithm == "decision_tree" else 8))),
        "minInstancesPerNode": max(1, int(p.get("minSamples", 2)) // 2),
        "seed": SEED,
    }
    if algorithm == "logistic_regression":
        return LogisticRegression(**columns, maxIter=int(p.get("epochs", 200)), regParam=p.get("lambda", 0.01))
    if algorithm == "linear_regression":
        return LinearRegression(**columns, regParam=p.get("lambda", 0.0))
    if algorithm == "decision_tree":
        return (DecisionTreeClassifier if classification else DecisionTreeRegressor)(**tree)
    if algorithm == "random_forest":
        kind = RandomForestClassifier if classification else RandomForestRegressor
        return kind(**tree, numTrees=int(p.get("nTrees", 10)), featureSubsetStrategy="sqrt")
    if algorithm == "gradient_boosting":
        boost = {
            **columns, "maxIter": int(p.get("nTrees", 30)), "stepSize": p.get("learningRate", 0.1),
            "maxDepth": int(p.get("maxDepth", 4)), "seed": SEED,
        }
        return (GBTClassifier if classification else GBTRegressor)(**boost)
    if algorithm == "svm":
        margin = LinearSVC(**columns, maxIter=int(p.get("epochs", 100)), regParam=1.0 / (p.get("C", 1.0) * max(rows, 1)))
        return margin if classes <= 2 else OneVsRest(classifier=margin, parallelism=4, **columns)
    if algorithm == "naive_bayes":
        return NaiveBayes(**columns, modelType="gaussian", smoothing=p.get("smoothing", 1e-9))
    raise ValueError(f"unknown algorithm {algorithm!r}")


def _with_expression(prediction: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("prediction", prediction)


# Numbers in a partition of training rows: 128 MB as doubles.
PARTITION_NUMBERS = 16_000_000


def gathered(df: DataFrame, rows: int, width: int) -> DataFrame:
    """The same rows in no more partitions than cores, or than their numbers need.

    Spark's learners start a task per partition in every pass, and each hands on sums for every open node
    of a tree, so a small table in the 200 partitions of a join costs as much as a large one.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows * width // PARTITION_NUMBERS))
    return df.coalesce(parts) if df.rdd.getNumPartitions() > parts else df


def fit(
    algorithm: str,
    train: DataFrame,
    features: Sequence[str],
    classification: bool,
    params: Mapping[str, float] | None = None,
    key: str = "row_id",
) -> Fitted:
    """Train one learner on columns `features` and `label`; nearest neighbours also need a key, of any type."""
    p = dict(params or {})
    names = list(features)
    if algorithm == "baseline":
        model = learners.fit_baseline(train, "label", classification)
        return Fitted(algorithm, names, _with_expression(model.predict(names)), [], model)
    if algorithm in ("linear_regression", "ridge_regression"):
        linear = algorithm == "linear_regression"
        penalty = p.get("lambda", 0.001 if linear else 1.0)
        model = (learners.fit_linear if linear else learners.fit_ridge)(train, names, "label", penalty)
        return Fitted(algorithm, names, _with_expression(model.predict()), model.importance(), model)
    if algorithm == "naive_bayes":
        model = learners.fit_naive_bayes(train, names, "label", p.get("smoothing", 1e-9))
        return Fitted(algorithm, names, _with_expression(model.predict()), [], model)
    if algorithm in ("logistic_regression", "svm") and "learningRate" in p:
        return _fit_steps(algorithm, train, names, p)
    if algorithm in HISTOGRAM:
        return _fit_histogram(algorithm, train, names, classification, p, key)
    if algorithm == "knn":
        return _fit_knn(train, names, min(int(p.get("k", 5)), max(1, train.count() // 2)), key)
    held = train.is_cached
    train = train.persist()
    try:
        return _fit_spark(algorithm, train, names, classification, p)
    finally:
        if not held:
            train.unpersist()


def _fit_spark(algorithm: str, train: DataFrame, names: list[str], classification: bool, p: Mapping[str, float]) -> Fitted:
    """Train one of Spark's learners on rows that are kept at hand for its many passes."""
    rows = train.count()
    classes = int(train.agg(F.countDistinct("label")).first()[0]) if classification else 0
    if algorithm == "gradient_boosting" and classes > 2:
        return _fit_histogram(algorithm, train, names, classification, p, "")
    steps: list = [VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")]
    if algorithm == "svm":
        steps = [
            VectorAssembler(inputCols=names, outputCol="raw_features", handleInvalid="keep"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        ]
    learner = estimator(algorithm, classification, rows, classes, p)
    fitted = Pipeline(stages=[*steps, learner]).fit(gathered(train, rows, len(names) + 1))
    importance = _top_importance(names, _weights(fitted.stages[-1], len(names)) or [0.0] * len(names))
    return Fitted(algorithm, names, fitted.transform, importance, fitted)


def _fit_steps(algorithm: str, train: DataFrame, names: list[str], p: Mapping[str, float]) -> Fitted:
    """Logistic or support-vector model by as many gradient steps as `epochs`, of the size `learningRate`."""
    steps, size = int(p.get("epochs", 200)), float(p["learningRate"])
    if algorithm == "logistic_regression":
        model = descent.fit_logistic(train, names, "label", size, steps, p.get("lambda", 0.01))
    else:
        model = descent.fit_svm(train, names, "label", p.get("C", 1.0), size, steps)
    return Fitted(algorithm, names, _with_expression(model.predict()), model.importance(), model)


def _fit_histogram(
    algorithm: str, train: DataFrame, names: list[str], classification: bool, p: Mapping[str, float], key: str
) -> Fitted:
    """A tree, a forest of drawn rows, or boosting; more than two boosted classes share a softmax."""
    smallest = int(p.get("minSamples", 2))
    if algorithm == "histogram_tree":
        model = histogram_trees.fit_forest(
            train, names, "label", classification, 1, int(p.get("maxDepth", depth_for(train.count(), 15))), smallest
        )
    elif algorithm == "histogram_forest":
        model = histogram_trees.fit_forest(
            train, names, "label", classification, int(p.get("nTrees", 10)), int(p.get("maxDepth", 8)), smallest, key
        )
    else:
        model = histogram_trees.fit_boosting(
            train, names, "label", classification, int(p.get("nTrees", 30)), p.get("learningRate", 0.1),
            int(p.get("maxDepth", 4)), smallest,
        )
    return Fitted(algorithm, names, model.predict, model.importance(), model)


def _fit_knn(train: DataFrame, names: list[str], k: int, key: str) -> Fitted:
    """Standardised features; every training row stays a possible neighbour."""
    from tabwright.operators.clean import apply_scale, fit_scale
    from tabwright.operators.neighbors import as_vector, classify_by_neighbors, nearest

    scales = fit_scale(train, names)
    train_id = long_key(train, key)

    def points(df, row_id):
        return as_vector(apply_scale(df, scales), names).withColumn("id", row_id)

    def score(df):
        row_id = long_key(df, key)
        found = nearest(points(df, row_id), points(train, train_id), k)
        labels = train.select(train_id.alias("neighbor"), "label")
        votes = classify_by_neighbors(found, labels, k).select(F.col("id").alias("_id"), F.col("label").alias("prediction"))
        return df.withColumn("_id", row_id).join(votes, "_id", "left").drop("_id")

    return Fitted("knn", names, score)


def save_model(model: Model, path: str) -> None:
    """Write a fitted Spark model so that another job can load it."""
    model.write().overwrite().save(path)


def refused(error: Exception) -> bool:
    """Whether a learner turned its data down, as opposed to a lost executor or a broken plan."""
    if isinstance(error, (ValueError, ArithmeticError, IllegalArgumentException, ArithmeticException)):
        return True
    cause = error.java_exception if isinstance(error, Py4JJavaError) else None
    while cause is not None:
        if cause.getClass().getName() in ("java.lang.IllegalArgumentException", "java.lang.ArithmeticException"):
            return True
        cause = cause.getCause()
    return False


def rank_candidates(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    classification: bool,
    algorithms: Sequence[str] | None = None,
    folds: int = 0,
    key: str = "row_id",
):
    """(leaderboard, fitted learners by algorithm), best first.

    Learners are tried a few at a time, baseline included; one that refuses the table keeps a row with
    its error, any other failure ends the run. With `folds` the rank follows the cross-validated score over all rows; the board then
    has the score of every fold, their mean and their deviation. Classes are spread over the folds.
    """
    spark = train.sparkSession
    wanted = list(dict.fromkeys([*(algorithms or CANDIDATES[classification]), "baseline"]))
    main = "accuracy" if classification else "r2"
    measure = classification_metrics if classification else regression_metrics
    train, test = train.persist(), test.persist()
    folded = _folded(train.unionByName(test), classification, folds, key).persist() if folds else None

    def attempt(algorithm):
        started = time.time()
        try:
            fitted = fit(algorithm, train, features, classification, key=key)
            measured = [measure(fitted.predict(part), "label", "prediction").first().asDict() for part in (train, test)]
        except Exception as error:  # a learner that cannot handle this table must not stop the others
            if not refused(error):
                raise
            return (algorithm, "error", str(error)[:200], *[None] * 7), None
        took = time.time() - started
        each = mean = spread = None
        if folded is not None and algorithm != "baseline":
            each = _cv_scores(algorithm, folded, features, classification, key)
            mean, spread = statistics.fmean(each), statistics.pstdev(each)
        clean = [{k: float(v) for k, v in m.items() if v is not None} for m in measured]
        importance = [{"feature": f, "importance": s} for f, s in fitted.importance]
        return (algorithm, "ok", None, clean[1], clean[0], importance, took, mean, spread, each), fitted

    try:
        for part in (train, test):
            part.count()
        outcomes = side_by_side(attempt, wanted)
    finally:
        train.unpersist()
        test.unpersist()
        if folded is not None:
            folded.unpersist()
    rows = [row for row, _ in outcomes]
    trained = {row[0]: fitted for row, fitted in outcomes if fitted is not None}
    board = spark.createDataFrame(
        rows,
        "algorithm string, status string, message string, test_metrics map<string,double>, "
        "train_metrics map<string,double>, feature_importance array<struct<feature:string,importance:double>>, "
        "duration_sec double, cv_score double, cv_std double, fold_scores array<double>",
    )
    score = F.col("cv_score") if folds else F.col("test_metrics")[main]
    return board.withColumn("score", score).orderBy(F.desc_nulls_last("score"), "algorithm"), trained


def _folded(df: DataFrame, classification: bool, folds: int, key: str) -> DataFrame:
    """`_fold` per row: dealt out class by class, or by a hash of the key where there are no classes."""
    dealt = stratified_folds(df, "label", key, folds) if classification else None
    if dealt is not None:
        return dealt.withColumnRenamed("fold", "_fold")
    return df.withColumn("_fold", F.floor(unit_hash(key) * folds))


def _cv_scores(algorithm, df, features, classification, key) -> list[float]:
    if algorithm in CLOSED and not classification:
        found = fold_products.fold_scores(df, features, "label", "_fold", [CLOSED[algorithm]], algorithm == "ridge_regression")
        return [score for _, _, score in found]
    measure = classification_metrics if classification else regression_metrics
    scores = []
    for (number,) in df.select("_fold").distinct().orderBy("_fold").collect():
        try:
            fitted = fit(algorithm, df.where(F.col("_fold") != number), features, classification, key=key)
            held_out = fitted.predict(df.where(F.col("_fold") == number))
            score = measure(held_out, "label", "prediction").first()["accuracy" if classification else "r2"]
            scores.append(0.0 if score is None else float(score))
        except Exception as error:  # a fold that cannot be trained counts as 0
            if not refused(error):
                raise
            scores.append(0.0)
    return scores


def range_values(low: float, high: float, step: float, about: int = 8) -> list[float]:
    """The step grid of a parameter, thinned to about `about` values with both ends kept."""
    values = [round(low + i * step, 3) for i in range(int((high - low) / step + 1e-9) + 1)]
    if len(values) <= about:
        return values
    stride = len(values) // (about - 1)
    return [*values[: len(values) - 1 : stride], values[-1]]


def parameter_grid(ranges: Mapping[str, Sequence[float]]) -> Iterator[dict[str, float]]:
    """Every combination of the thinned ranges."""
    lists = [range_values(*r[:3]) for r in ranges.values()]
    for combination in product(*lists):
        yield dict(zip(ranges, combination, strict=True))


def random_parameters(ranges: Mapping[str, Sequence[float]], draws: int = 20, seed: int = SEED) -> list[dict[str, float]]:
    """Seeded draws from the step grid."""
    random = Random(seed)
    return [
        {name: round(low + random.randint(0, round((high - low) / step)) * step, 3) for name, (low, high, step, *_) in ranges.items()}
        for _ in range(draws)
    ]


def parameter_ranges(spark) -> DataFrame:
    """Tunable parameters as rows."""
    return spark.createDataFrame(
        [(a, name, *map(float, r)) for a, ranges in TUNABLE.items() for name, r in ranges.items()],
        "algorithm string, parameter string, low double, high double, step double, usual double",
    )


def grid_table(ranges: DataFrame, about: int = 8) -> DataFrame:
    """Combinations of parameter values from rows (name, low, high, step), one column per name.

    The lists hold at most 13 values each; they are opened one after the other, without a join.
    """
    last = F.floor((F.col("high") - F.col("low")) / F.col("step") + 1e-9).cast("int")
    grid = F.transform(F.sequence(F.lit(0), last), lambda i: F.round(F.col("low") + i * F.col("step"), 3))
    stride = F.greatest(F.lit(1), F.floor(F.size("grid") / (about - 1)).cast("int"))
    thin = F.filter("grid", lambda v, i: (F.size("grid") <= about) | (i == F.size("grid") - 1) | (i % stride == 0))
    lists = ranges.withColumn("grid", grid).select("name", thin.alias("values"))
    names = [r.name for r in lists.select("name").orderBy("name").collect()]
    row = lists.agg(F.map_from_entries(F.collect_list(F.struct("name", "values"))).alias("m"))
    for name in names:
        row = row.select("m", *[n for n in names if n in row.columns], F.explode(F.col("m")[name]).alias(name))
    return row.drop("m")


@dataclass(frozen=True)
class _Nodes:
    """A fitted tree's nodes by number, 0 the root; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    prediction: np.ndarray


def _tree_nodes(model: Any, spark) -> _Nodes:
    """Nodes as Spark's model writes them down."""
    path = f"{ensure_checkpoint_dir(spark)}/tree-{uuid.uuid4().hex}"
    save_model(model, path)
    columns = ["id", "prediction", "leftChild", "rightChild", "split.featureIndex", "split.leftCategoriesOrThreshold"]
    rows = spark.read.parquet(f"{path}/data").select(*columns).orderBy("id").toPandas()
    own, inner = rows["id"].to_numpy(), rows["leftChild"].to_numpy() >= 0
    cuts = np.array([c[0] if i else 0.0 for c, i in zip(rows["leftCategoriesOrThreshold"], inner, strict=True)])
    left, right = (np.where(inner, rows[c].to_numpy(), own) for c in ("leftChild", "rightChild"))
    return _Nodes(np.maximum(rows["featureIndex"].to_numpy(), 0), cuts, left, right, rows["prediction"].to_numpy())


def _predicted_at(df: DataFrame, names: Sequence[str], nodes: _Nodes, depths: Sequence[int]) -> DataFrame:
    """(label, p0, p1, ...): what the tree says when it is cut below each of the depths, which are sorted."""
    shared = df.sparkSession.sparkContext.broadcast(nodes)

    def run(frames):
        tree = shared.value
        for frame in frames:
            x = frame[list(names)].to_numpy(dtype=float)
            at, rows, out, level = np.zeros(len(x), dtype=np.int64), np.arange(len(x)), {"label": frame["label"]}, 0
            for i, depth in enumerate(depths):
                for _ in range(depth - level):
                    at = np.where(x[rows, tree.feature[at]] <= tree.threshold[at], tree.left[at], tree.right[at])
                level = depth
                out[f"p{i}"] = tree.prediction[at]
            yield pd.DataFrame(out)

    columns = ", ".join(f"p{i} double" for i in range(len(depths)))
    numbers = [F.col(quoted(n)).cast("double").alias(n) for n in names]
    return df.select(*numbers, F.col("label").cast("double").alias("label")).mapInPandas(run, f"label double, {columns}")


def _tree_scores(
    train: DataFrame, test: DataFrame, names: Sequence[str], classification: bool, combinations: Sequence[Mapping[str, float]], key: str
) -> list[float | None]:
    """The score of every combination of depth and least rows; None where a learner refused its deepest tree.

    Splits are chosen level by level, so a tree of less depth is the deeper one of the same least rows, cut:
    one tree is grown for each number of least rows, and one pass over `test` gives all its depths.
    """
    measure = classification_metrics if classification else regression_metrics
    plain = [estimator("decision_tree", classification, 0, 2, {"maxDepth": 1, **c}) for c in combinations]
    least, depth = [e.getMinInstancesPerNode() for e in plain], [e.getMaxDepth() for e in plain]

    def grown(rows: int) -> dict[int, float]:
        depths = sorted({d for m, d in zip(least, depth, strict=True) if m == rows})
        deepest = next(c for c, m, d in zip(combinations, least, depth, strict=True) if (m, d) == (rows, depths[-1]))
        try:
            fitted = fit("decision_tree", train, names, classification, deepest, key)
        except Exception as error:  # each depth then stands for itself
            if not refused(error):
                raise
            return {}
        found = _predicted_at(test, names, _tree_nodes(fitted.model.stages[-1], train.sparkSession), depths).persist()
        scores = {}
        for i, d in enumerate(depths):
            score = measure(found, "label", f"p{i}").first()["accuracy" if classification else "r2"]
            scores[d] = float("-inf") if score is None else float(score)
        found.unpersist()
        return scores

    kinds = sorted(set(least))
    scores = dict(zip(kinds, side_by_side(grown, kinds), strict=True))
    return [scores[m].get(d) for m, d in zip(least, depth, strict=True)]


@dataclass
class Tuning:
    trials: DataFrame
    best_params: dict[str, float]
    best_score: float
    original_score: float

    @property
    def improvement(self) -> float:
        return self.best_score - self.original_score


def tune(
    algorithm: str,
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    classification: bool,
    combinations: Sequence[Mapping[str, float]],
    original_score: float = 0.0,
    key: str = "row_id",
) -> Tuning:
    """Fit every combination, score it on the held-out part; a trial the learner refuses ranks last.

    Penalties of linear and ridge regression are all tried on the sums of one scan, depths of a tree on one tree.
    """
    spark = train.sparkSession
    measure = classification_metrics if classification else regression_metrics
    main = "accuracy" if classification else "r2"
    train, test = train.persist(), test.persist()

    def trial(numbered):
        number, params = numbered
        try:
            fitted = fit(algorithm, train, features, classification, params, key)
            score = measure(fitted.predict(test), "label", "prediction").first()[main]
            score = float("-inf") if score is None else float(score)
        except Exception as error:  # a combination the learner refuses is a lost trial
            if not refused(error):
                raise
            score = float("-inf")
        return number, {k: float(v) for k, v in params.items()}, score

    try:
        if algorithm in CLOSED and not classification:
            penalties = [float(c.get("lambda", CLOSED[algorithm])) for c in combinations]
            scores = fold_products.held_out_scores(train, test, features, "label", penalties, algorithm == "ridge_regression")
            rows = [
                (number, {k: float(v) for k, v in params.items()}, score)
                for number, (params, score) in enumerate(zip(combinations, scores, strict=True))
            ]
        else:
            for part in (train, test):
                part.count()
            shared = algorithm == "decision_tree" and all("maxDepth" in c for c in combinations)
            known = _tree_scores(train, test, features, classification, combinations, key) if shared else [None] * len(combinations)
            rest = side_by_side(trial, [(i, c) for i, (c, score) in enumerate(zip(combinations, known, strict=True)) if score is None])
            done = [(i, {k: float(v) for k, v in c.items()}, s) for i, (c, s) in enumerate(zip(combinations, known, strict=True)) if s is not None]
            rows = sorted([*done, *rest], key=lambda r: r[0])
    finally:
        train.unpersist()
        test.unpersist()
    best = max(rows, key=lambda r: (r[2], -r[0]))
    trials = spark.createDataFrame(rows, "trial int, params map<string,double>, score double")
    return Tuning(trials.orderBy(F.desc("score"), "trial").limit(10), best[1], best[2], original_score)


def apply_best(algorithm, tuning: Tuning, train, features, classification, key="row_id") -> Fitted | None:
    """Refit with the best parameters, or None when they bring no gain."""
    if tuning.improvement <= 0:
        return None
    return fit(algorithm, train, features, classification, tuning.best_params, key)
