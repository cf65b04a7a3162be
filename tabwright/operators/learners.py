"""Learners whose fit is one aggregation: baseline, linear, ridge, naive Bayes, nearest neighbours.

Each fit brings back a handful of sums (bounded by the number of features and classes) and each
prediction is a plain column expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import quoted, sigmoid
from tabwright.functions.vectors import dot, total, unpack

NARROW = 16
MAX_CLASSES = 1_000


def feature_columns(names: Sequence[str]) -> list[Column]:
    return [F.col(quoted(n)).cast("double") for n in names]


@dataclass
class ConstantModel:
    """Predicts the mean, or the most frequent class."""

    value: float
    algorithm: str = "baseline"

    def predict(self, features: Sequence[str]) -> Column:
        return F.lit(self.value)


@dataclass
class LinearModel:
    """Intercept first, then one coefficient per feature."""

    features: list[str]
    coefficients: list[float]
    algorithm: str = "linear_regression"

    def predict(self, features: Sequence[str] | None = None) -> Column:
        return F.lit(self.coefficients[0]) + dot(self.coefficients[1:], feature_columns(features or self.features))

    def predict_class(self) -> Column:
        """Class 1 where the sigmoid of the score reaches one half."""
        return F.when(sigmoid(self.predict()) >= 0.5, 1.0).otherwise(0.0)

    def probability(self) -> Column:
        return sigmoid(self.predict())

    def importance(self, top: int = 10) -> list[tuple[str, float]]:
        """Share of the absolute weights, largest first."""
        sizes = [abs(c) for c in self.coefficients[1:]]
        whole = sum(sizes)
        if whole == 0:
            return []
        ranked = sorted(zip(self.features, sizes, strict=True), key=lambda item: (-item[1], item[0]))
        return [(name, size / whole) for name, size in ranked[:top]]


def fit_baseline(df: DataFrame, label: str, classification: bool) -> ConstantModel:
    if not classification:
        return ConstantModel(df.agg(F.avg(label)).first()[0])
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return ConstantModel(counts.orderBy(F.desc("_n"), label).first()[0])


def cross_products(df: DataFrame, features: Sequence[str], label: str):
    """(X'X, X'y) with a leading column of ones.

    A few features become p*p sums in one generated aggregation. Many would make that code too
    large: then every task multiplies its own rows and hands on one matrix, and Spark adds those
    up cell by cell.
    """
    columns = [F.lit(1.0), *feature_columns(features), F.col(quoted(label)).cast("double")]
    size = len(columns)
    whole = np.zeros((size, size))
    if size <= NARROW:
        cells = [(i, j) for i in range(size) for j in range(i, size)]
        sums = df.agg(*[F.sum(columns[i] * columns[j]) for i, j in cells]).first()
    else:
        slim = df.select(F.array(*columns).alias("row")).where(~F.exists("row", lambda v: v.isNull()))
        parts = slim.mapInPandas(_partial_products(size), "products array<double>")
        added = parts.select(F.posexplode("products").alias("cell", "v")).groupBy("cell").agg(F.sum("v").alias("v"))
        cells = [(i, j) for i in range(size) for j in range(size)]
        found = {r.cell: r.v for r in added.collect()}
        sums = [found.get(n, 0.0) for n in range(len(cells))]
    for (i, j), value in zip(cells, sums, strict=True):
        whole[i, j] = whole[j, i] = value
    return whole[:-1, :-1], whole[:-1, -1]


def _partial_products(size: int):
    def products(frames):
        held = np.zeros((size, size))
        for frame in frames:
            rows = unpack(frame["row"])
            if len(rows):
                held += rows.T @ rows
        yield pd.DataFrame({"products": [held.ravel()]})

    return products


def solve(gram: np.ndarray, moment: np.ndarray) -> list[float]:
    try:
        return [float(v) for v in np.linalg.solve(gram, moment)]
    except np.linalg.LinAlgError:
        return [float(v) for v in np.linalg.lstsq(gram, moment, rcond=None)[0]]


def fit_linear(df: DataFrame, features: Sequence[str], label: str, penalty: float = 0.001) -> LinearModel:
    """Normal equations with the same small penalty on every diagonal entry."""
    gram, moment = cross_products(df, features, label)
    return LinearModel(list(features), solve(gram + penalty * np.eye(len(moment)), moment))


def fit_ridge(df: DataFrame, features: Sequence[str], label: str, penalty: float = 1.0) -> LinearModel:
    """Normal equations with the penalty on the slopes and 0.001 on the intercept."""
    gram, moment = cross_products(df, features, label)
    diagonal = np.diag([0.001, *[penalty] * len(features)])
    return LinearModel(list(features), solve(gram + diagonal, moment), "ridge_regression")


@dataclass
class NaiveBayesModel:
    """Per class: prior, and mean and variance of each feature."""

    features: list[str]
    classes: list[float]
    priors: list[float]
    means: list[list[float]]
    variances: list[list[float]]
    algorithm: str = "naive_bayes"

    def scores(self) -> list[Column]:
        """Log joint density per class, as column expressions."""
        x = feature_columns(self.features)
        out = []
        for prior, means, variances in zip(self.priors, self.means, self.variances, strict=True):
            constant = math.log(prior) + sum(-0.5 * math.log(2 * math.pi * v) for v in variances)
            gaps = [(c - F.lit(m)) * (c - F.lit(m)) / F.lit(2 * v) for c, m, v in zip(x, means, variances, strict=True)]
            out.append(F.lit(constant) - total(gaps))
        return out

    def predict(self, features: Sequence[str] | None = None) -> Column:
        ranked = [
            F.struct(score.alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c"))
            for i, (score, c) in enumerate(zip(self.scores(), self.classes, strict=True))
        ]
        return F.array_max(F.array(*ranked))["c"]


def class_statistics(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row per class: count, and mean and population variance of every feature."""
    x = feature_columns(features)
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"mean_{n}") for n, c in zip(features, x, strict=True)],
        *[F.var_pop(c).alias(f"var_{n}") for n, c in zip(features, x, strict=True)],
    )


def fit_naive_bayes(df: DataFrame, features: Sequence[str], label: str, smoothing: float = 1e-9) -> NaiveBayesModel:
    stats = class_statistics(df, features, label).orderBy(label).limit(MAX_CLASSES + 1).collect()
    if len(stats) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    whole = sum(r.n for r in stats)
    return NaiveBayesModel(
        list(features),
        [float(r[label]) for r in stats],
        [r.n / whole for r in stats],
        [[float(r[f"mean_{f}"]) for f in features] for r in stats],
        [[float(r[f"var_{f}"]) + smoothing for f in features] for r in stats],
    )
