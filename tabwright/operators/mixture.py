"""Gaussian mixture with diagonal covariance: expectation rounds of one aggregation each."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.sampling import SEED
from tabwright.functions.vectors import unpack
from tabwright.operators.cluster import Clustering, kmeans

LEAST_VARIANCE = 1e-6


@dataclass
class Mixture(Clustering):
    """Hard labels with what each component is: weight, mean (in `centers`) and variances.

    `log_likelihoods`: of all points under the components that each round began with.
    """

    variances: list[list[float]] | None = None
    log_likelihoods: list[float] | None = None


def _log_densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Rows by components: logarithm of weight times density."""
    out = np.empty((len(x), len(weights)))
    for c, (weight, mean, variance) in enumerate(zip(weights, means, variances, strict=True)):
        own = np.maximum(variance, LEAST_VARIANCE)
        gaps = (x - mean) ** 2
        out[:, c] = math.log(weight + 1e-300) - 0.5 * np.log(2 * math.pi * own).sum() - (gaps / (2 * own)).sum(axis=1)
    return out


def diagonal_mixture(points: DataFrame, centers: Sequence[Sequence[float]], rounds: int = 50) -> Mixture:
    """Mixture from given centers, unit variances and equal weights; each round reads the points once.

    A round sums, per component, the shares, shares times x and shares times squared distance to the
    old mean, from which the new mean and variance follow without a second pass. Shares are taken from
    differences of logarithms, so far points do not underflow. A component that is left without
    points (less than 1e-6 in all) stays as it is. Equal shares label with the first component. No
    points leave the start as it is.
    """
    means = np.array(centers, dtype=float)
    kinds, width = means.shape
    variances = np.ones((kinds, width))
    weights = np.full(kinds, 1 / kinds)
    likelihoods: list[float] = []
    held = points.select("id", "vec").persist()
    try:
        for _ in range(rounds):

            def sums(frames, weights=weights, means=means, variances=variances):
                total = np.zeros(kinds * (2 * width + 1) + 2)
                for frame in frames:
                    if not len(frame):
                        continue
                    x = unpack(frame["vec"])
                    logs = _log_densities(x, weights, means, variances)
                    top = logs.max(axis=1, keepdims=True)
                    whole = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
                    shares = np.exp(logs - whole[:, None])
                    first = np.stack([shares[:, c] @ (x - means[c]) for c in range(kinds)])
                    second = np.stack([shares[:, c] @ (x - means[c]) ** 2 for c in range(kinds)])
                    own = np.concatenate([shares.sum(axis=0), first.ravel(), second.ravel(), [whole.sum(), len(x)]])
                    total += own
                yield pd.DataFrame({"cell": np.arange(len(total)), "v": total})

            added = held.mapInPandas(sums, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
            found = {r.cell: r.v for r in added.collect()}
            total = np.array([found.get(i, 0.0) for i in range(kinds * (2 * width + 1) + 2)])
            if not total[-1]:
                break
            n = total[:kinds]
            first = total[kinds : kinds * (width + 1)].reshape(kinds, width)
            second = total[kinds * (width + 1) : -2].reshape(kinds, width)
            likelihoods.append(float(total[-2]))
            alive = n >= 1e-6
            shift = np.where(alive[:, None], first / np.maximum(n, 1e-300)[:, None], 0.0)
            spread = second / np.maximum(n, 1e-300)[:, None] - shift**2
            means = means + shift
            variances = np.where(alive[:, None], np.maximum(spread, LEAST_VARIANCE), variances)
            weights = np.where(alive, n / total[-1], weights)
    finally:
        held.unpersist()

    def label(frames):
        for frame in frames:
            if len(frame):
                logs = _log_densities(unpack(frame["vec"]), weights, means, variances)
                yield pd.DataFrame({"id": frame["id"], "cluster": logs.argmax(axis=1).astype("int32")})

    labels = points.select("id", "vec").mapInPandas(label, "id long, cluster int")
    return Mixture(
        "diagonal_mixture", labels, means.tolist(), weights=weights.tolist(), variances=variances.tolist(),
        log_likelihoods=likelihoods,
    )


def fit_diagonal_mixture(points: DataFrame, k: int, rounds: int = 50, seed: int = SEED) -> Mixture:
    """`diagonal_mixture` from the centers that k-means finds."""
    return diagonal_mixture(points, kmeans(points, k, seed=seed).centers, rounds)
