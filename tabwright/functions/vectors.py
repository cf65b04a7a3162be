"""Distances and products on array and column vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS_AT_ONCE = 4_000_000
FEW_COLUMNS = 6
NEAR = 1e-3


def total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def dot(weights: Sequence[float], features: Sequence[Column]) -> Column:
    return total([F.lit(float(w)) * x for w, x in zip(weights, features, strict=True)])


def squared_distance(features: Sequence[Column], point: Sequence[float]) -> Column:
    return total([(x - F.lit(float(c))) * (x - F.lit(float(c))) for x, c in zip(features, point, strict=True)])


def array_squared_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)


def array_dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def unpack(values) -> np.ndarray:
    """Stack a pandas column of arrays into a matrix."""
    return np.array(list(values), dtype=float)


def slices(rows: int, width: int) -> Iterator[slice]:
    """Row ranges whose distance block to `width` other rows stays small."""
    step = max(1, CELLS_AT_ONCE // max(1, width))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


def pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two blocks, summed gap by gap for accuracy."""
    squared = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        gap *= gap
        squared += gap
    return np.sqrt(squared, out=squared)


def rough_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and per row of `a` how far they may be off."""
    left, right = (a * a).sum(axis=1), (b * b).sum(axis=1)
    return left[:, None] + right[None, :] - 2 * (a @ b.T), 1e-9 * (left + right.max() + 1e-300)


def block_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances as `pairwise` gives them (but for about 1e-12 of each), by one matrix product.

    A product is off by a share of the norms, not of the distance: rows are centred, and pairs that are near
    against their norms are summed gap by gap, as are rows of few columns or with numbers that overflow.
    """
    if a.shape[1] <= FEW_COLUMNS or not len(a) or not len(b):
        return pairwise(a, b)
    with np.errstate(over="ignore", invalid="ignore"):
        middle = b.mean(axis=0)
        x, y = a - middle, b - middle
        norms = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    if not np.isfinite(norms).all():
        return pairwise(a, b)
    squared = norms - 2 * (x @ y.T)
    rows, columns = np.nonzero(squared <= NEAR * norms)
    out = np.sqrt(np.maximum(squared, 0.0))
    for part in slices(len(rows), a.shape[1]):
        out[rows[part], columns[part]] = exact_distance(a, b, rows[part], columns[part])
    return out


def exact_distance(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Distances of chosen pairs."""
    gaps = a[rows] - b[columns]
    return np.sqrt((gaps * gaps).sum(axis=1))
