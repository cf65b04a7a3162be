"""Quality classifier by co-training: the text and the page's metadata teach each other.

Two logistic models look at separate features: one at the text, one at where it comes from. Over
some rounds each labels the unlabelled documents it is surest of, and the other learns from them
too. Both are calibrated on labels, and the mean of their calibrated log-odds, weighted by how well
each separates the labels, scores every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.store import keep, small
from tabwright.llm.texts import groups_of, hash_group, text_bytes

SAMPLE_ROWS = 20_000
ROUNDS = 4
CONFIDENT = 0.1
HASHED = 64
METADATA = 96
GROUP_BYTES = 1 << 20
KINDS = np.zeros(256, dtype=np.int64)
KINDS[[9, 10, 11, 12, 13, 32]] = 1
KINDS[48:58] = 2
KINDS[65:91] = 3
KINDS[97:123] = 4
KINDS[128:] = 5
KINDS[[33, 63]] = 6
KINDS[[44, 46, 59, 58, 39, 34, 40, 41, 45]] = 7
N_KINDS = 8
TEXT_FEATURES = N_KINDS + 9 + HASHED


@dataclass(frozen=True)
class View:
    """Standardisation, logistic coefficients, calibration (slope, shift) and weight of one classifier."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    slope: float
    shift: float
    weight: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * ((x - self.mean) / self.scale @ self.beta[1:] + self.beta[0]) + self.shift


@dataclass(frozen=True)
class Model:
    text: View
    page: View
    rounds: tuple[tuple[int, int], ...]


def text_features(texts: list[bytes]) -> np.ndarray:
    """Per text: shares of character kinds, length, repetition of words and lines, word lengths, hashed words."""
    out = np.zeros((len(texts), TEXT_FEATURES), dtype=np.float32)
    row = 0
    for group in groups_of(texts, GROUP_BYTES):
        _, begin, end, hashes, firsts = hash_group(group)
        ends = np.r_[firsts[1:], len(hashes)]
        for text, a, b in zip(group, firsts.tolist(), ends.tolist(), strict=True):
            chars = np.bincount(KINDS[np.frombuffer(text, dtype=np.uint8)], minlength=N_KINDS)
            own, sizes = hashes[a:b], end[a:b] - begin[a:b]
            words, lines = max(1, b - a), text.split(b"\n")
            distinct = np.unique(own)
            same = float((own[1:] == own[:-1]).mean()) if b - a > 1 else 0.0
            buckets = np.bincount((distinct >> np.uint64(40)).astype(np.int64) % HASHED, minlength=HASHED)
            out[row] = np.concatenate(
                [
                    chars / max(1, len(text)),
                    [
                        math.log1p(len(text)),
                        math.log1p(b - a),
                        len(distinct) / words,
                        same,
                        float(sizes.mean()) / 10 if b > a else 0.0,
                        float(sizes.std()) / 10 if b > a else 0.0,
                        1 - len(set(lines)) / len(lines),
                        len(lines) / words,
                        float((sizes == 1).mean()) if b > a else 0.0,
                    ],
                    buckets / max(1, len(distinct)),
                ]
            )
            row += 1
    return out


def page_features(frame: pd.DataFrame) -> np.ndarray:
    """Hashed one-hot of source, language, host, its parts and the URL's shape; length and number of pages."""
    out = np.zeros((len(frame), METADATA + 3), dtype=np.float32)
    for name in ("source", "lang", "host", "domain", "scheme", "shape"):
        values = frame[name].fillna("").astype(str)
        place = values.map({v: hash_text(f"{name}={v}") % METADATA for v in values.unique()}).to_numpy(dtype=np.int64)
        np.add.at(out, (np.arange(len(frame)), place), 1)
    out[:, METADATA] = np.log1p(frame["n_chars"].fillna(0).to_numpy(dtype=float))
    out[:, METADATA + 1] = np.log1p(frame["n_pages"].fillna(0).to_numpy(dtype=float))
    out[:, METADATA + 2] = (frame["n_pages"].fillna(0) > 0).to_numpy(dtype=float)
    return out


def hash_text(value: str) -> int:
    total = 0
    for byte in value.encode():
        total = (total * 1_000_003 + byte) % (1 << 61)
    return total


def page_metadata(pages: DataFrame, id_col: str = "doc_id", url_col: str = "url") -> DataFrame:
    """One row per document: number of pages and the URL parts of its smallest URL.

    A page tells its document's id as the number at the end of its URL's path.
    """
    parts = pages.select(
        F.regexp_extract(url_col, r"/(\d+)/?(?:\.\w+)?(?:[?#].*)?$", 1).try_cast("long").alias(id_col), F.col(url_col).alias("_url")
    ).where(F.col(id_col).isNotNull())
    one = parts.groupBy(id_col).agg(F.count("*").alias("n_pages"), F.min("_url").alias("_url"))
    host = F.regexp_extract("_url", r"://([^/]+)", 1)
    return one.select(
        id_col,
        "n_pages",
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.regexp_extract("_url", r"^(\w+)://", 1).alias("scheme"),
        F.regexp_replace(F.regexp_replace(F.regexp_replace("_url", r"^\w+://[^/]+", ""), r"\d+", "0"), "[a-z]+", "a").alias("shape"),
    )


META_COLUMNS = ("source", "lang", "n_chars", "n_pages", "host", "domain", "scheme", "shape")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3.0) -> np.ndarray:
    xs = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta = np.zeros(xs.shape[1])
    penalty = ridge * np.eye(xs.shape[1])
    penalty[0, 0] = 1e-2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(xs @ beta, -30, 30)))
        hessian = xs.T @ (xs * (weight * p * (1 - p))[:, None]) + penalty
        step = np.linalg.solve(hessian, xs.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _view(x: np.ndarray, y: np.ndarray, known: np.ndarray, weight: np.ndarray) -> View:
    """A classifier on all rows with a (pseudo-)label, calibrated by cross-fitting on the given ones."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - mean) / scale
    raw = np.zeros(len(y))
    for part in (0, 1):
        inside = np.arange(len(y)) % 2 == part
        beta = _logistic(z[~inside], y[~inside], weight[~inside])
        raw[inside] = z[inside] @ beta[1:] + beta[0]
    slope, shift, gain = 1.0, 0.0, 0.0
    if known.sum() > 1 and 0 < y[known].mean() < 1:
        fitted = _logistic(raw[known, None], y[known], np.ones(known.sum()), ridge=1e-3)
        shift, slope = float(fitted[0]), max(0.0, float(fitted[1]))
        p = 1 / (1 + np.exp(-np.clip(slope * raw[known] + shift, -30, 30)))
        rate = y[known].mean()
        entropy = -(rate * math.log(rate) + (1 - rate) * math.log(1 - rate))
        loss = -np.mean(y[known] * np.log(p + 1e-12) + (1 - y[known]) * np.log(1 - p + 1e-12))
        gain = max(0.0, 1 - loss / entropy)
    return View(mean, scale, _logistic(z, y, weight), slope, shift, gain)


def fit(sample: pd.DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT) -> Model:
    """Co-training on rows with text features, metadata and a label or none.

    Each round the classifier of one view labels the share `confident` of the still unlabelled
    rows it is surest of, as many of each class as the labels have, for the other view only.
    """
    sample = sample.sort_values("doc_id", kind="stable").reset_index(drop=True)
    text = np.array(sample["features"].tolist(), dtype=np.float64).reshape(len(sample), TEXT_FEATURES)
    page = page_features(sample).astype(np.float64)
    label = sample["label"].to_numpy(dtype=float)
    given = ~np.isnan(label)
    rate = float(label[given].mean()) if given.any() else 0.5
    learned = [np.where(given, label, np.nan), np.where(given, label, np.nan)]
    history = []
    for _ in range(rounds if given.any() else 0):
        views = [_learn(x, y, given) for x, y in zip((text, page), learned, strict=True)]
        added = []
        for own, other in ((0, 1), (1, 0)):
            if views[own].weight < 0.02:
                added.append(0)  # a view that tells nothing about the labels teaches nothing
                continue
            logit = views[own].logit((text, page)[own])
            free = np.flatnonzero(np.isnan(learned[other]))
            share = confident * len(free)
            order = free[np.argsort(logit[free], kind="stable")]
            low, high = int(share * (1 - rate)), int(share * rate)
            bad, good = order[:low], order[len(order) - high :] if high else order[:0]
            bad, good = bad[logit[bad] < -2], good[logit[good] > 2]
            learned[other][bad], learned[other][good] = 0, 1
            added.append(len(bad) + len(good))
        history.append((added[0], added[1]))
    return Model(_learn(text, learned[0], given), _learn(page, learned[1], given), tuple(history))


def _learn(x: np.ndarray, y: np.ndarray, given: np.ndarray) -> View:
    rows = ~np.isnan(y)
    if not rows.any():
        return View(x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1), 1.0, 0.0, 0.0)
    return _view(x[rows], y[rows], given[rows], np.where(given[rows], 1.0, 0.5))


def _text_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = text_features(text_bytes(batch.column("text")))
        offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * TEXT_FEATURES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1)))], names=["row", "features"]
        )


def _text_logits(shared: Broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            logits = model.text.logit(text_features(text_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(logits.astype(np.float64))], names=["row", "text_logit"]
            )

    return run


def _combined(shared: Broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        total = model.text.weight + model.page.weight
        shares = [model.text.weight, model.page.weight] if total > 0 else [0.5, 0.5]
        for batch in batches:
            logits = [
                batch.column("text_logit").to_numpy(),
                model.page.logit(page_features(batch.select(list(META_COLUMNS)).to_pandas())),
            ]
            mixed = sum(w * x for w, x in zip(shares, logits, strict=True)) / sum(shares)
            odds = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (mixed, *logits)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(o.astype(np.float64)) for o in odds]],
                names=["doc_id", "score", "text_score", "page_score"],
            )

    return run


OWN_COLUMNS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long"}


def _fields() -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in OWN_COLUMNS.items())


def _own(docs: DataFrame) -> list:
    text = F.col("text").cast("string")
    return [
        F.struct(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"),
            F.length(text).cast("long").alias("n_chars"),
        ).alias("row"),
        text.alias("text"),
    ]


def _with_pages(own: DataFrame, pages: DataFrame) -> DataFrame:
    """A document without a page has none of its parts."""
    found = page_metadata(pages).withColumnRenamed("doc_id", "_page")
    return own.join(found, F.col("doc_id") == F.col("_page"), "left").drop("_page")


def sample_rows(docs: DataFrame, pages: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """About `rows` documents with a label and as many without, picked by a hash of the id: features, not texts.

    `labels` has doc_id and label; a document with several labels counts once, with the largest.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).where(F.col("_id").isNotNull()).distinct()
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("label").cast("double").alias("label"))
    marked = keep(ids.join(known, "_id", "left"))
    total, with_label = marked.agg(F.count("*"), F.count("label")).first()
    limits = [min(1.0, rows / max(1, n)) * 1_000_000 for n in (with_label, total - with_label)]
    draw = F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1_000_000))
    picked = marked.where(draw < F.when(F.col("label").isNotNull(), limits[0]).otherwise(limits[1]))
    texts = docs.join(small(picked), F.col("doc_id").cast("long") == F.col("_id"))
    label = F.struct(*[F.col(f"row.{c}") for c in OWN_COLUMNS], "label").alias("row")
    featured = (
        texts.select(*_own(texts), "label")
        .select(label, "text")
        .mapInArrow(_text_features, f"row struct<{_fields()}, label:double>, features array<float>")
        .select("row.*", "features")
    )
    return _with_pages(featured, pages).toPandas()


def score(docs: DataFrame, pages: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: better), text_score, page_score of every row of `docs`.

    Texts are read where they lie; only the text's log-odds are joined with the metadata. Null and
    empty texts are scored as they are, without characters; missing metadata is a value of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = docs.select(*_own(docs)).mapInArrow(_text_logits(shared), f"row struct<{_fields()}>, text_logit double")
    joined = _with_pages(read.select("row.*", "text_logit"), pages)
    return joined.select("doc_id", "text_logit", *META_COLUMNS).mapInArrow(
        _combined(shared), "doc_id long, score double, text_score double, page_score double"
    )
