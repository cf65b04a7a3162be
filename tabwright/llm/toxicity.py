"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme values.

Words get the log-odds of toxic against clean documents under an informative Dirichlet prior, taken
at the lower end of their confidence interval; all other words share one small negative score. One
linear scan of a text finds every maximal segment. Segment scores are judged by the Gumbel law that
the best segments of clean documents follow at their length, and a logistic curve on the summed
evidence turns them into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.store import keep

WORDS = re.compile(r"[^\W\d_]+")
PRIOR_SHARE = 0.1
CONFIDENCE = 2.58
MAX_TERMS = 100_000
CALIBRATION_ROWS = 20_000
COUNTED_WORDS = 200_000
EULER = 0.5772156649


@dataclass(frozen=True)
class Model:
    """Word weights above 0, the score of any other word, Gumbel parameters, and logistic coefficients."""

    weights: dict[str, float]
    drift: float
    rate: float
    scale: float
    coefficients: tuple[float, ...]


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) in one pass.

    `scores` lists the positions with a positive score in order; every position between them
    scores `drift` (negative). Candidates are kept with the cumulative sums at both their ends; a
    new one is joined with the nearest earlier one that starts lower, as long as it ends higher.
    Each candidate remembers that earlier one, so the search skips what lies between.
    """
    total, at = 0.0, -1
    kept: list[tuple[int, int, float, float, int]] = []
    for position, score in scores:
        total += drift * (position - at - 1)
        first, low = position, total
        total += score
        high, at = total, position
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((first, position, low, high, j))
    return [(first, last, high - low) for first, last, low, high, _ in kept]


def _term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word and label, summed over a task as far as memory allows."""
    counts = (Counter(), Counter())

    def drained() -> Iterator[pa.RecordBatch]:
        for label, counter in enumerate(counts):
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pa.array(list(counter), pa.string()),
                    "toxic": pa.array(np.array(list(counter.values()), dtype=np.int64) * label),
                    "clean": pa.array(np.array(list(counter.values()), dtype=np.int64) * (1 - label)),
                }
            )
            counter.clear()

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            counts[label].update(set(words_of(text)))
            if len(counts[0]) + len(counts[1]) > COUNTED_WORDS:
                yield from drained()
    yield from drained()


def _weights(labelled: DataFrame) -> tuple[dict[str, float], float]:
    counts = keep(
        labelled.mapInArrow(_term_counts, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    sums = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    toxic, clean = float(sums[0] or 0), float(sums[1] or 0)
    if not toxic or not clean:
        return {}, -0.01
    mass = PRIOR_SHARE * (toxic + clean)
    prior = PRIOR_SHARE * (F.col("toxic") + F.col("clean"))
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(t / (toxic + mass - t)) - F.log(c / (clean + mass - c))
    low = odds - CONFIDENCE * F.sqrt(1 / t + 1 / c)
    found = (
        counts.where(F.col("toxic") >= 2)
        .withColumn("low", low)
        .where("low > 0")
        .orderBy(F.desc("low"), "term")
        .limit(MAX_TERMS)
        .toPandas()
    )
    weights = dict(zip(found["term"], found["low"].astype(float), strict=True))
    rest = (1 - found["toxic"].sum() / toxic) / max(1e-9, 1 - found["clean"].sum() / clean)
    return weights, min(math.log(max(rest, 1e-6)), -0.01)


def _evidence(words: list[str], model: Model) -> tuple[float, float, float, int, int]:
    """Best segment's score and its normalised one, summed normalised scores of the significant segments, their number."""
    weights = model.weights
    marked = [(i, weights[w]) for i, w in enumerate(words) if w in weights]
    scores = [s for _, _, s in segments(marked, model.drift)]
    if not scores:
        return 0.0, 0.0, 0.0, 0, len(words)
    base = math.log(max(model.scale * len(words), 1e-12))
    normal = [model.rate * s - base for s in scores]
    good = [x for x in normal if x > 0]
    return max(scores), max(0.0, max(normal)), sum(good), len(good), len(words)


def _features(best: np.ndarray, normal: np.ndarray, summed: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.stack(
        [np.ones_like(best), np.log1p(np.maximum(normal, 0)), np.log1p(summed), np.log1p(count), (best > 0) * 1.0], axis=1
    )


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the intercept."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(labelled: DataFrame) -> Model:
    """A model from rows (text, label 0/1); rows without a label or text teach nothing.

    Word counts cover all rows; the MAX_TERMS strongest of the significant words are kept, as the
    model is broadcast. The Gumbel law and the logistic curve are fitted on a hash sample
    of about CALIBRATION_ROWS of them.
    """
    rows = keep(
        labelled.select(F.col("text").cast("string").alias("text"), F.col("label").cast("long").alias("label")).where(
            F.col("text").isNotNull() & F.col("label").isin(0, 1)
        )
    )
    weights, drift = _weights(rows)
    share = min(1.0, CALIBRATION_ROWS / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    draft = Model(weights, drift, 1.0, 1.0, ())
    frame = _scan(sample, draft, ("label",)).toPandas()
    clean = frame[frame["label"] == 0]
    spread = float(clean["best"].std()) if len(clean) > 1 else 0.0
    rate = min(5.0, math.pi / (spread * math.sqrt(6))) if spread > 1e-6 else 5.0
    lengths = np.log(np.maximum(clean["n_words"].to_numpy(dtype=float), 1.0))
    location = (rate * clean["best"].mean() - EULER - lengths.mean()) if len(clean) else 0.0
    draft = Model(weights, drift, rate, math.exp(location), ())
    if not len(frame):
        return Model({}, drift, 1.0, 1.0, (-4.0, 0.0, 0.0, 0.0, 0.0))
    frame = _scan(sample, draft, ("label",)).toPandas()
    x = _features(*(frame[c].to_numpy(dtype=float) for c in ("best", "normal", "summed", "found")))
    beta = _logistic(x, frame["label"].to_numpy(dtype=float))
    return Model(weights, drift, rate, math.exp(location), tuple(beta.tolist()))


def _scanner(shared: Broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            found = [_evidence(words_of(t), model) for t in batch.column("text").to_pylist()]
            best, normal, summed, count, size = (np.array(c) for c in zip(*found, strict=True))
            score = np.zeros(len(best))
            if model.coefficients:
                score = 1 / (1 + np.exp(-np.clip(_features(best, normal, summed, count) @ model.coefficients, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row")]
                + [pa.array(c, pa.float64()) for c in (score, best, normal, summed)]
                + [pa.array(c, pa.int64()) for c in (count, size)],
                names=["row", "score", "best", "normal", "summed", "found", "n_words"],
            )

    return run


def _scan(docs: DataFrame, model: Model, keep_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.struct(*keep_cols).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["row"].dataType.simpleString()
    columns = "score double, best double, normal double, summed double, found long, n_words long"
    return narrow.mapInArrow(_scanner(shared), f"row {kind}, {columns}").select(
        "row.*", "score", "best", "normal", "summed", "found", "n_words"
    )


def score(docs: DataFrame, model: Model, keep_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """`keep_cols` with score (0 to 1), best segment score, its normalised form, their sum, significant segments, words.

    Null and empty texts have no segment and get the score of a text without evidence.
    """
    return _scan(docs, model, keep_cols, text_col)


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The significant segments themselves: id, first and last word number, score, expected number by chance."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                marked = [(i, own.weights[w]) for i, w in enumerate(words) if w in own.weights]
                for first, last, value in segments(marked, own.drift):
                    chance = own.scale * len(words) * math.exp(-own.rate * value)
                    if chance < 1:
                        rows.append((doc_id, first, last, value, chance))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["id", "first", "last", "score", "chance"],
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, first long, last long, score double, chance double")
