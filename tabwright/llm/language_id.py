"""Language identification by cross-parsing entropy.

Each language is a suffix automaton of sample texts. A text is cut greedily into the longest
phrases that occur in the sample; a language that needs few phrases per character fits well. The
automata are dense tables of next states, so thousands of text pieces are parsed side by side,
one character of each per step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.store import keep, small
from tabwright.llm.texts import portions, released

UNDETERMINED = "und"
SAMPLE_ROWS = 64
SAMPLE_TEXT = 4_000
SAMPLE_CHARS = 40_000
STATE_BUDGET = 600_000
PIECE = 256
BATCH_BYTES = 1_000_000
CUT = np.int32(1 << 30)
POINTS = 0x40000  # no letter lies beyond


@dataclass(frozen=True)
class Model:
    """languages; character classes of the code points below POINTS; one table of next states each.

    An entry is the state after the character; CUT is added where no phrase goes on with it, and
    the state is then the one after the character alone.
    """

    languages: tuple[str, ...]
    classes: np.ndarray
    tables: tuple[np.ndarray, ...]


def _base_classes() -> np.ndarray:
    """Letters by lower case (0: no letter). The first one of a lower-casing that gives several counts."""
    out = np.zeros(POINTS, dtype=np.uint32)
    for point in range(POINTS):
        char = chr(point)
        if char.isalpha():
            out[point] = ord(char.lower()[0])
    return out


def _letters(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters of all texts, runs of others as one 0 ahead of each word, and the ends of the texts."""
    points = [np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
    flat = np.concatenate(points) if points else np.zeros(0, dtype=np.uint32)
    ends = np.cumsum([len(p) for p in points])
    kind = classes[np.minimum(flat, POINTS - 1)]
    starts = np.zeros(len(flat), dtype=bool)
    begin = np.r_[0, ends[:-1]]
    starts[begin[begin < len(flat)]] = True
    other = kind == 0
    drop = other & ~starts
    drop[1:] &= other[:-1]
    kept = ~drop
    return kind[kept], np.cumsum(kept)[ends - 1] * (ends > 0) if len(flat) else ends


def _automaton(sample: np.ndarray, width: int) -> np.ndarray:
    """Next states of the suffix automaton of `sample` (character classes below `width`)."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in sample.tolist():
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and symbol not in following[at]:
            following[at][symbol] = state
            at = link[at]
        if at != -1:
            target = following[at][symbol]
            if length[at] + 1 == length[target]:
                link[state] = target
            else:
                clone = len(following)
                following.append(dict(following[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at != -1 and following[at].get(symbol) == target:
                    following[at][symbol] = clone
                    at = link[at]
                link[target] = link[state] = clone
        last = state
    first = np.full(width, CUT, dtype=np.int32)
    for symbol, state in following[0].items():
        first[symbol] = CUT + np.int32(state)
    table = np.tile(first, (len(following), 1))
    for state, targets in enumerate(following):
        for symbol, target in targets.items():
            table[state, symbol] = target
    return table


def fit(labelled: DataFrame, text_col: str, lang_col: str) -> Model:
    """A model from rows with text and language.

    Bounded sample: the SAMPLE_ROWS distinct texts with the smallest hash per language among those of at
    most SAMPLE_TEXT characters; as many of them, whole, as have SAMPLE_CHARS letters together (less
    if there are so many languages that the tables would pass STATE_BUDGET states). Rows without text
    or language teach nothing. A language whose texts are all longer is learned from the first
    SAMPLE_CHARS letters of its shortest one.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    hashed = rows.select(
        "lang",
        F.when(F.length("text") > SAMPLE_TEXT, F.length("text")).otherwise(0).alias("over"),
        F.xxhash64("text", F.lit(11)).alias("hash"),
        "text",
    )
    place = Window.partitionBy("lang").orderBy("over", "hash")
    ranked = hashed.select("lang", "over", "hash").distinct().withColumn("rank", F.row_number().over(place))
    chosen = small(keep(ranked.where((F.col("rank") <= SAMPLE_ROWS) & ((F.col("over") == 0) | (F.col("rank") == 1)))))
    texts = hashed.join(chosen, ["lang", "over", "hash"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    picked = texts.orderBy("lang", "rank").collect()
    languages = tuple(sorted({row["lang"] for row in picked}))
    base = _base_classes()
    limit = min(SAMPLE_CHARS, STATE_BUDGET // (2 * max(1, len(languages))))
    samples = []
    for language in languages:
        found, ends = _letters([row["text"] for row in picked if row["lang"] == language], base)
        fitting = ends[ends <= limit]
        samples.append(found[: fitting[-1] if len(fitting) else limit])
    symbols = np.unique(np.concatenate([*samples, np.zeros(1, dtype=np.uint32)]))
    code = np.full(POINTS, len(symbols), dtype=np.uint32)
    code[symbols] = np.arange(len(symbols))
    classes = np.where(base > 0, np.maximum(code[base], 1), 0).astype(np.uint32)
    tables = tuple(_automaton(code[sample], len(symbols) + 1) for sample in samples)
    return Model(languages, classes, tables)


def _phrases(model: Model, kinds: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters and, per language, phrases of each text.

    Parsing starts anew every PIECE characters. A character the samples lack is no part of any
    phrase there; it counts as one together with the phrase after it.
    """
    lengths = np.diff(np.r_[0, ends])
    pieces = -(-lengths // PIECE)
    owner = np.repeat(np.arange(len(ends)), pieces)
    begin = np.concatenate([np.arange(p) * PIECE for p in pieces]) if len(pieces) else np.zeros(0, dtype=np.int64)
    begin = begin.astype(np.int64) + np.r_[0, ends[:-1]][owner]
    size = np.minimum(PIECE, ends[owner] - begin)
    order = np.argsort(-size, kind="stable")
    begin, size, owner = begin[order], size[order], owner[order]
    active = np.searchsorted(-size, -np.arange(PIECE), side="left")
    counts = np.zeros((len(model.languages), len(ends)), dtype=np.int64)
    for index, table in enumerate(model.tables):
        width = table.shape[1]
        flat = table.reshape(-1)
        state = np.zeros(len(begin), dtype=np.int32)
        cuts = np.ones(len(begin), dtype=np.int32)
        for step in range(PIECE):
            live = int(active[step])
            if live == 0:
                break
            here = flat[state[:live] * np.int32(width) + kinds[begin[:live] + step]]
            cut = here >= CUT
            cuts[:live] += cut
            state[:live] = here & (CUT - 1)
        counts[index] = np.bincount(owner, weights=cuts, minlength=len(ends)).astype(np.int64)
    return lengths, counts


def _predictor(shared: Broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for part in portions(batches, limit=BATCH_BYTES):
            yield _judged(model, part.column("row"), [t or "" for t in part.column("text").to_pylist()])

    return run


def _judged(model: Model, rows: pa.Array, texts: list[str]) -> pa.RecordBatch:
    kinds, ends = _letters(texts, model.classes)
    prefix = np.r_[0, np.cumsum(kinds > 0)]
    letters = prefix[ends] - prefix[np.r_[0, ends[:-1]].astype(np.int64)]
    known = (letters > 0) & bool(model.languages)
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if model.languages:
        lengths, counts = _phrases(model, kinds, ends)
        rate = counts / np.maximum(lengths, 1)
        best = np.argmin(rate, axis=0)
        # Phrases saved against another language, as bits of evidence of a phrase's length each.
        saved = np.clip((counts - counts.min(axis=0)) * 2.0, 0, 60)
        scores = np.where(known, 1 / np.exp2(-saved).sum(axis=0), 0.0)
        names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
    return pa.RecordBatch.from_arrays(
        [rows, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
        names=["row", "lang_pred", "score"],
    )


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep_cols` of every row of `docs`, lang_pred and score (0 to 1, the share of the evidence).

    A null text, one without a letter, or a model without languages gives `und` with score 0. Ties
    go to the language that sorts first. Texts are read whole, in pieces; other columns stay out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.struct(*keep_cols).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["row"].dataType.simpleString()
    found = narrow.mapInArrow(released(_predictor(shared)), f"row {kind}, lang_pred string, score double")
    return found.select("row.*", "lang_pred", "score")
