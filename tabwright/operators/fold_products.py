"""Linear and ridge models of all folds and all penalties from one scan.

A fold's sums of products say all that a linear fit and its R² need: the sums of the other folds are
the total less its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import quoted
from tabwright.functions.vectors import unpack
from tabwright.operators.learners import NARROW, feature_columns, solve

MAX_FOLDS = 1_000


def fold_products(df: DataFrame, features: Sequence[str], label: str, fold: str) -> dict[int, np.ndarray]:
    """For each fold the products of 1, the features and the label with each other, summed over its rows.

    Rows with a missing value are left out. More than 1,000 folds raise, as their sums go to the driver.
    """
    columns = [F.lit(1.0), *feature_columns(features), F.col(quoted(label)).cast("double")]
    size = len(columns)
    rows = df.select(F.col(quoted(fold)).cast("int").alias("fold"), F.array(*columns).alias("row"))
    rows = rows.where(F.col("fold").isNotNull() & ~F.exists("row", lambda v: v.isNull()))
    if size <= NARROW:
        cells = [(i, j) for i in range(size) for j in range(i, size)]
        row = F.col("row")
        sums = rows.groupBy("fold").agg(*[F.sum(row[i] * row[j]).alias(f"c{n}") for n, (i, j) in enumerate(cells)])
        found = {}
        for r in sums.limit(MAX_FOLDS + 1).collect():
            found[r.fold] = np.zeros((size, size))
            for n, (i, j) in enumerate(cells):
                found[r.fold][i, j] = found[r.fold][j, i] = r[f"c{n}"]
    else:

        def partial(frames):
            held: dict[int, np.ndarray] = {}
            for frame in frames:
                for number, own in frame.groupby("fold"):
                    x = unpack(own["row"])
                    held[number] = held.get(number, 0) + x.T @ x
            for number, total in held.items():
                yield pd.DataFrame({"fold": number, "line": np.arange(size), "v": list(total)})

        def added(key, frame):
            return pd.DataFrame({"fold": [key[0]], "line": [key[1]], "v": [unpack(frame["v"]).sum(axis=0)]})

        schema = "fold int, line int, v array<double>"
        lines = rows.mapInPandas(partial, schema).groupBy("fold", "line").applyInPandas(added, schema)
        found = {}
        for r in lines.limit(MAX_FOLDS * size + 1).collect():
            found.setdefault(r.fold, np.zeros((size, size)))[r.line] = r.v
    if len(found) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} folds")
    return found


def coefficients(products: np.ndarray, penalty: float, ridge: bool) -> list[float]:
    """Intercept and slopes from sums of products; ridge spares the intercept but for 0.001."""
    size = len(products) - 1
    diagonal = np.full(size, float(penalty))
    if ridge:
        diagonal[0] = 0.001
    return solve(products[:-1, :-1] + np.diag(diagonal), products[:-1, -1])


def r_squared(products: np.ndarray, weights: Sequence[float]) -> float:
    """R² of a linear model on the rows whose products these are; 0 where the label does not vary."""
    n, total, squares = products[0, 0], products[0, -1], products[-1, -1]
    spread = squares - total * total / n if n else 0.0
    if spread <= 0:
        return 0.0
    w = np.array(weights)
    left = squares - 2 * w @ products[:-1, -1] + w @ products[:-1, :-1] @ w
    return float(1 - left / spread)


def fold_scores(
    df: DataFrame, features: Sequence[str], label: str, fold: str, penalties: Sequence[float], ridge: bool
) -> list[tuple[float, int, float]]:
    """(penalty, fold, R² on the fold of the model of all other folds), for every pair, from one scan."""
    found = fold_products(df, features, label, fold)
    whole = sum(found.values())
    return [
        (p, number, r_squared(own, coefficients(whole - own, p, ridge)))
        for p in penalties
        for number, own in sorted(found.items())
    ]


def held_out_scores(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, penalties: Sequence[float], ridge: bool
) -> list[float]:
    """R² on `test` of the model of `train` for each penalty, from one scan of both."""
    names = [*features, label]
    both = train.select(*map(quoted, names), F.lit(1).alias("_part")).unionByName(
        test.select(*map(quoted, names), F.lit(0).alias("_part"))
    )
    found = fold_products(both, features, label, "_part")
    if 0 not in found or 1 not in found:
        return [0.0 for _ in penalties]
    return [r_squared(found[0], coefficients(found[1], p, ridge)) for p in penalties]
