"""Exact order statistics and correlation that hold at any table size."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import chunks, number

# A percentile_disc buffer keeps one entry per distinct value; it only ever sees this many rows.
EXACT_ROWS = 100_000
SKETCH_ACCURACY = 10_000
COLUMNS_PER_JOB = 16


@dataclass
class _Search:
    """One wanted rank and the bracket its value is known to lie in."""

    name: str
    slot: str
    probability: float
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    @property
    def bracket(self) -> tuple[str, float | None, float | None]:
        return self.slot, self.low, self.high

    def share(self) -> float:
        return (self.rank - self.below + 0.5) / self.inside


def _within(bracket: tuple[str, float | None, float | None]) -> Column:
    slot, low, high = bracket
    return F.col(slot) if low is None else F.when(F.col(slot).between(low, high), F.col(slot))


def _around(share: float, accuracy: int) -> list[float]:
    """Probabilities whose sketched values enclose the wanted one, and the wanted one itself."""
    slack = 2.0 / accuracy
    return [max(0.0, share - slack), share, min(1.0, share + slack)]


def order_stats(
    df: DataFrame,
    targets: Mapping[str, Sequence[float]],
    exact_rows: int = EXACT_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, dict[float, float | None]]:
    """`sorted(values)[floor(n*p)]` per column: no interpolation, no global sort.

    One scan sketches the quantiles and counts the values, a second one counts exactly how many
    lie below the sketched values around each wanted rank. Often one of them is the answer; if
    not, they enclose it, and `percentile_disc` reads what lies between them. While more than
    `exact_rows` values lie between, the enclosed part is sketched again, which shrinks it by the
    sketch accuracy each time. No task ever holds a whole column.
    """
    return order_stats_and_counts(df, targets, exact_rows, accuracy)[0]


def order_stats_and_counts(
    df: DataFrame,
    targets: Mapping[str, Sequence[float]],
    exact_rows: int = EXACT_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> tuple[dict[str, dict[float, float | None]], dict[str, int]]:
    """`order_stats` and the number of values present per column."""
    found = {name: dict.fromkeys(probabilities) for name, probabilities in targets.items()}
    sizes: dict[str, int] = {}
    for block in chunks(targets, COLUMNS_PER_JOB):
        slots = {name: f"v{i}" for i, name in enumerate(block)}
        slim = df.select(*[number(df, name).alias(slot) for name, slot in slots.items()])
        grids = {name: [q for p in targets[name] for q in _around(p, accuracy)] for name in block}
        first = slim.agg(
            *[F.count(slots[name]) for name in block],
            *[F.percentile_approx(slots[name], grids[name], accuracy) for name in block],
        ).first()
        searches, guesses = [], []
        for name, size, values in zip(block, first[: len(block)], first[len(block) :], strict=True):
            sizes[name] = size
            for place, p in enumerate(targets[name] if size else ()):
                searches.append(_Search(name, slots[name], p, min(math.floor(size * p), size - 1), size))
                guesses.append(values[3 * place : 3 * place + 3])
        if searches:
            _enclose(slim, searches, guesses)
            _resolve(slim, searches, exact_rows, accuracy)
        for search in searches:
            found[search.name][search.probability] = search.value
    return found, sizes


def _resolve(slim: DataFrame, searches: list[_Search], exact_rows: int, accuracy: int) -> None:
    while wanted := [s for s in searches if s.value is None]:
        if small := [s for s in wanted if s.inside <= exact_rows]:
            _read_brackets(slim, small)
        if large := [s for s in wanted if s.inside > exact_rows]:
            brackets = list(dict.fromkeys(s.bracket for s in large))
            grids = {b: [q for s in large if s.bracket == b for q in _around(s.share(), accuracy)] for b in brackets}
            row = slim.agg(*[F.percentile_approx(_within(b), grids[b], accuracy) for b in brackets]).first()
            sketched = dict(zip(brackets, map(list, row), strict=True))
            guesses = []
            for s in large:
                guesses.append(sketched[s.bracket][:3])
                del sketched[s.bracket][:3]
            _enclose(slim, large, guesses)


def _read_brackets(slim: DataFrame, searches: list[_Search]) -> None:
    """The exact value of each search from the rows inside any of the brackets."""
    inside = reduce(or_, [_within(s.bracket).isNotNull() for s in searches])
    held = slim.where(inside).select(*[_within(s.bracket).alias(f"w{i}") for i, s in enumerate(searches)])
    exact = [f"percentile_disc({s.share()!r}D) WITHIN GROUP (ORDER BY w{i})" for i, s in enumerate(searches)]
    for search, value in zip(searches, held.agg(*map(F.expr, exact)).first(), strict=True):
        search.value = value


def _enclose(slim: DataFrame, searches: list[_Search], guesses: list[Sequence[float]]) -> None:
    """Count around the guessed values; settle a search or shrink its bracket."""
    cuts: dict[str, list[float]] = {}
    for search, guess in zip(searches, guesses, strict=True):
        cuts[search.slot] = sorted({*cuts.get(search.slot, ()), *guess})
    ranks = _count_around(slim, cuts)
    for search, guess in zip(searches, guesses, strict=True):
        edges = sorted((cut, *ranks[search.slot, cut]) for cut in set(guess))
        for cut, under, upto in edges:
            if under <= search.rank < upto:
                search.value = cut
        if search.value is not None:
            continue
        start, end = search.below, search.below + search.inside
        low = -math.inf if search.low is None else search.low
        high = math.inf if search.high is None else search.high
        for cut, under, _ in edges:
            if under <= search.rank:
                low, start = cut, under
        for cut, _, upto in reversed(edges):
            if upto > search.rank:
                high, end = cut, upto
        search.low, search.high, search.below, search.inside = low, high, start, end - start


def _count_around(slim: DataFrame, cuts: Mapping[str, Sequence[float]]) -> dict[tuple[str, float], tuple[int, int]]:
    """(values below, values up to) each cut of each column.

    A value's place among the sorted cuts is twice the cuts below it, plus one if it equals a
    cut. Tasks count their rows per (column, place) by binary search, which leaves a few dozen groups:
    a comparison per cut and row made code too large to be compiled.
    """
    sorted_cuts = {slot: np.array(values, dtype=float) for slot, values in cuts.items()}

    def count(batches):
        held = {slot: np.zeros(2 * len(values) + 1, dtype=np.int64) for slot, values in sorted_cuts.items()}
        for batch in batches:
            for slot, values in sorted_cuts.items():
                x = batch.column(slot).drop_null().to_numpy(zero_copy_only=False)
                place = np.searchsorted(values, x, "left") + np.searchsorted(values, x, "right")
                held[slot] += np.bincount(place, minlength=2 * len(values) + 1)
        for slot, found in held.items():
            places = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([slot] * len(places), pa.string()), pa.array(places, pa.int32()), pa.array(found[places], pa.int64())],
                names=["slot", "place", "n"],
            )

    parts = slim.select(*sorted_cuts).mapInArrow(count, "slot string, place int, n long")
    counts = parts.groupBy("slot", "place").agg(F.sum("n").alias("count"))
    tally = {(r.slot, r.place): r["count"] for r in counts.collect()}
    found = {}
    for slot, values in cuts.items():
        below = 0
        for i, cut in enumerate(values):
            below += tally.get((slot, 2 * i), 0)
            upto = below + tally.get((slot, 2 * i + 1), 0)
            found[slot, cut] = (below, upto)
            below = upto
    return found


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], factor: float = 1.5, min_rows: int = 4, skip_flat: bool = False
) -> dict[str, tuple[float, float]]:
    """Fences `q1 - f*iqr`, `q3 + f*iqr` per column; columns with too few values are left out."""
    quartiles, sizes = order_stats_and_counts(df, {name: (0.25, 0.75) for name in columns})
    bounds = {}
    for name in columns:
        q1, q3 = quartiles[name][0.25], quartiles[name][0.75]
        if sizes[name] >= min_rows and not (skip_flat and q1 == q3):
            bounds[name] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return bounds


def correlation(a: Column, b: Column) -> Column:
    """Pearson r over the pairs where both are present; 0 when either side is constant."""
    var_a = F.var_pop(F.when(b.isNotNull(), a))
    var_b = F.var_pop(F.when(a.isNotNull(), b))
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.sqrt(var_a * var_b)), F.lit(0.0))


def correlation_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], pairs_per_job: int = 400) -> DataFrame:
    """Long table (x, y, n, r) for the named column pairs, many pairs per scan."""
    blocks = []
    for block in chunks(pairs, pairs_per_job):
        aggregates = []
        for i, (x, y) in enumerate(block):
            a, b = number(df, x), number(df, y)
            aggregates += [
                F.count_if(a.isNotNull() & b.isNotNull()).alias(f"n{i}"),
                correlation(a, b).alias(f"r{i}"),
            ]
        rows = [
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"))
            for i, (x, y) in enumerate(block)
        ]
        blocks.append(df.agg(*aggregates).select(F.inline(F.array(*rows))))
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out
