"""Logistic and support-vector models by full-batch gradient steps: learning rate and epochs as given.

An epoch is one pass: tasks add up the gradient of their rows, Spark adds the tasks' numbers cell by
cell, and the driver, which holds only the weights, takes one step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import quoted, sigmoid
from tabwright.functions.vectors import dot
from tabwright.operators.histogram_trees import class_values
from tabwright.operators.learners import feature_columns
from tabwright.session import written


@dataclass
class DescentModel:
    """Linear scores, one row of weights (intercept first) per class, or one in all for two classes.

    `means` and `spreads` scale the features before they are weighed (0 and 1 where they are raw).
    """

    algorithm: str
    features: list[str]
    classes: list[float]
    weights: list[list[float]]
    means: list[float]
    spreads: list[float]
    losses: list[float] = field(default_factory=list)
    kind: str = "descent"

    def scores(self) -> list[Column]:
        scaled = [
            (x - F.lit(m)) / F.lit(s) for x, m, s in zip(feature_columns(self.features), self.means, self.spreads, strict=True)
        ]
        return [F.lit(w[0]) + dot(w[1:], scaled) for w in self.weights]

    def predict(self, features: Sequence[str] | None = None) -> Column:
        """The class with the highest score, of equal ones the smallest; two classes split at a score of 0."""
        if len(self.classes) < 2:
            return F.lit(self.classes[0] if self.classes else 0.0)
        scores = self.scores()
        if len(scores) == 1:
            return F.when(scores[0] >= 0, self.classes[1]).otherwise(self.classes[0])
        ranked = [
            F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c"))
            for i, (s, c) in enumerate(zip(scores, self.classes, strict=True))
        ]
        return F.array_max(F.array(*ranked))["c"]

    def probability(self) -> Column:
        """Probability of the second of two classes, from a logistic model."""
        return sigmoid(self.scores()[0])

    def importance(self, top: int = 10) -> list[tuple[str, float]]:
        """Share of the absolute weights, summed over classes, largest first."""
        sizes = np.abs(np.array(self.weights))[:, 1:].sum(axis=0)
        if not sizes.sum():
            return []
        shares = [(name, float(v)) for name, v in zip(self.features, sizes / sizes.sum(), strict=True)]
        return sorted(shares, key=lambda item: (-item[1], item[0]))[:top]


def _descend(
    rows: DataFrame,
    weights: np.ndarray,
    epochs: int,
    gradient: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, float]],
    step: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> tuple[np.ndarray, list[float]]:
    """Weights after `epochs` steps, and the mean loss before each of them.

    `gradient(x, y, weights)` sums the gradient and the loss of rows whose x begins with 1;
    `step(weights, mean gradient)` moves the weights.
    """
    losses = []
    shape = weights.shape
    for _ in range(epochs):

        def partial(frames, weights=weights):
            total = np.zeros(weights.size + 2)
            for frame in frames:
                if len(frame):
                    x = np.array(frame["x"].tolist(), dtype=float).reshape(len(frame), -1)
                    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                    slope, loss = gradient(x, frame["y"].to_numpy(), weights)
                    total += np.concatenate([slope.ravel(), [loss, len(frame)]])
            yield pd.DataFrame({"cell": np.arange(len(total)), "v": total})

        added = rows.mapInPandas(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
        found = {r.cell: r.v for r in added.collect()}
        total = np.array([found.get(i, 0.0) for i in range(weights.size + 2)])
        if not total[-1]:
            return weights, losses
        losses.append(float(total[-2] / total[-1]))
        weights = step(weights, total[:-2].reshape(shape) / total[-1])
    return weights, losses


def _training(df: DataFrame, features: Sequence[str], label: str, scales: Sequence[tuple[float, float]]) -> DataFrame:
    x = F.array(*[(c - F.lit(m)) / F.lit(s) for c, (m, s) in zip(feature_columns(features), scales, strict=True)])
    rows = df.select(x.alias("x"), F.col(quoted(label)).cast("double").alias("y"))
    return written(rows.where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull())))


def _listed(algorithm, features, classes, weights, scales, losses) -> DescentModel:
    return DescentModel(
        algorithm, list(features), classes, [[float(v) for v in w] for w in weights], *map(list, zip(*scales, strict=True)), losses
    )


def fit_logistic(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    learning_rate: float = 0.01,
    epochs: int = 200,
    penalty: float = 0.01,
) -> DescentModel:
    """Logistic regression by batch gradient descent from zero weights, on the features as they are.

    `penalty` shrinks all weights but the intercept. More than two classes share a softmax. Rows with a
    missing feature or label teach nothing; no rows or one class leave the weights at zero.
    """
    classes = class_values(df, label)
    scales = [(0.0, 1.0)] * len(features)
    rows = _training(df, features, label, scales)
    several = len(classes) > 2
    last = classes[-1] if classes else 0.0

    def gradient(x, y, weights):
        z = np.clip(x @ weights.T, -500, 500)
        if several:
            marks = (y[:, None] == np.array(classes)[None, :]).astype(float)
            powers = np.exp(z - z.max(axis=1, keepdims=True))
            p = powers / powers.sum(axis=1, keepdims=True)
            return (p - marks).T @ x, float(-np.log(np.maximum((p * marks).sum(axis=1), 1e-300)).sum())
        mark = (y == last).astype(float)
        p = 1 / (1 + np.exp(-z[:, 0]))
        own = np.where(mark > 0, p, 1 - p)
        return ((p - mark) @ x)[None, :], float(-np.log(np.maximum(own, 1e-300)).sum())

    def step(weights, mean):
        shrink = penalty * weights
        shrink[:, 0] = 0.0
        return weights - learning_rate * (mean + shrink)

    weights = np.zeros((len(classes) if several else 1, len(features) + 1))
    weights, losses = _descend(rows, weights, epochs if len(classes) > 1 else 0, gradient, step)
    return _listed("logistic_regression", features, classes, weights, scales, losses)


def fit_svm(
    df: DataFrame, features: Sequence[str], label: str, c: float = 1.0, learning_rate: float = 0.01, epochs: int = 200
) -> DescentModel:
    """Linear support vectors by sub-gradient steps on the mean hinge loss, on standardised features.

    A step is `learning_rate * (C * mean of y x over rows with a margin below 1 - w / n)`. The smaller
    of two classes is the negative one; of more, each has its own weights against the rest, all moved
    in the same pass.
    """
    classes = class_values(df, label)
    x = feature_columns(features)
    known = df.where(F.col(quoted(label)).isNotNull())
    found = known.agg(F.count(F.lit(1)), *[f(v) for v in x for f in (F.avg, F.stddev_pop)]).first()
    n, *ends = found
    scales = [(float(ends[2 * i] or 0.0), float(ends[2 * i + 1] or 0.0) or 1.0) for i in range(len(features))]
    rows = _training(df, features, label, scales)
    positive = np.array(classes[-1:] if len(classes) <= 2 else classes)

    def gradient(x, y, weights):
        sign = np.where(y[:, None] == positive[None, :], 1.0, -1.0)
        margin = sign * (x @ weights.T)
        inside = np.where(margin < 1, sign, 0.0)
        return -(inside.T @ x), float(np.maximum(1 - margin, 0).sum())

    def step(weights, mean):
        shrink = weights / max(n, 1)
        shrink[:, 0] = 0.0
        return weights - learning_rate * (c * mean + shrink)

    weights = np.zeros((max(1, len(positive)), len(features) + 1))
    weights, losses = _descend(rows, weights, epochs if len(classes) > 1 else 0, gradient, step)
    return _listed("svm", features, classes, weights, scales, losses)
