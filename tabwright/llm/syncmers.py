"""Closed-syncmer fingerprints of texts and of what an edit makes of them.

A k-mer of code points is an anchor when the smallest hash among its inner s-mers lies at one of
its two ends. The choice looks at the k-mer alone, so a passage keeps its anchors wherever it is
copied. The fingerprint is the sorted list of the smallest anchor hashes, in hex.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.store import small
from tabwright.llm.texts import MULTIPLIER, scramble

K = 15
S = 5
SKETCH = 64
SLICE_CHARS = 1_000_000
PART_ROWS = 4_096
MAX_PARTS = 10_000


def _polynomial(points: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    value = points[at].copy()
    for offset in range(1, width):
        value *= MULTIPLIER
        value += points[at + offset]
    return scramble(value)


def anchors_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of all anchors. A text without any is itself one anchor, an empty one has none."""
    encoded = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(e) for e in encoded], dtype=np.int64)
    points = np.concatenate([*encoded, np.zeros(K, dtype=np.uint32)]).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    n = len(owner)
    where, hashes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if n >= K:
        inner = points[: n - S + 1].copy()
        for offset in range(1, S):
            inner *= MULTIPLIER
            inner += points[offset : n - S + 1 + offset]
        inner = scramble(inner)
        span = K - S + 1
        low, width = inner, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: n - K + 1], low[span - width : n - K + 1 + span - width])
        chosen = (inner[: n - K + 1] == low) | (inner[span - 1 : n - K + span] == low)
        ends = begin + sizes
        chosen &= np.arange(n - K + 1) + K <= ends[owner[: n - K + 1]]
        where = np.flatnonzero(chosen)
        hashes = _polynomial(points, where, K)
    bare = sizes > 0
    bare[owner[where]] = False
    short = np.flatnonzero(bare)
    short_hash = np.array(
        [int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") for i in short],
        dtype=np.uint64,
    )
    text = np.concatenate([owner[where], short])
    position = np.concatenate([where - begin[owner[where]], np.zeros(len(short), dtype=np.int64)])
    return text, position, np.concatenate([hashes, short_hash])


def sketches(texts: list[str]) -> list[np.ndarray]:
    """For each text its SKETCH smallest distinct anchor hashes (32 bits), sorted."""
    text, _, hashes = anchors_of(texts)
    keys = np.sort((text.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    return [keys[a : min(b, a + SKETCH)].astype(np.uint32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common anchors (Dice), from the smallest hashes of both; two empty ones are alike."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    left, right = set(a.tolist()), set(b.tolist())
    union = sorted(left | right)[:SKETCH] if max(len(a), len(b)) >= SKETCH else left | right
    jaccard = sum(x in left and x in right for x in union) / len(union)
    return 2 * jaccard / (1 + jaccard)


def _hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text."""
    part = len(text) // 4
    return text[: len(text) - part] + following[:part]


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (part, extra, order): every row that is not extra, with the row after it."""
    pending: tuple | None = None

    def finished(rows: list[tuple]) -> pa.RecordBatch:
        """`rows` and the pending one: all but the last have their follower here."""
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[1]]
        edited = [edited_text(a[3], b[3]) for a, b in pairs]
        found = sketches([r[3] for r in rows] + edited)
        own = {id(r): s for r, s in zip(rows, found, strict=False)}
        after = found[len(rows) :]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([a[2] for a, _ in pairs], pa.int64()),
                "n_chars": pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                "edited_sha256": pa.array(
                    [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()
                ),
                "fingerprint": pa.array([_hex(own[id(a)]) for a, _ in pairs], pa.string()),
                "edited_fingerprint": pa.array([_hex(s) for s in after], pa.string()),
                "near_edited": pa.array([likeness(own[id(a)], s) for (a, _), s in zip(pairs, after, strict=True)], pa.float64()),
                "near_next": pa.array([likeness(own[id(a)], own[id(b)]) for a, b in pairs], pa.float64()),
            }
        )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text")]
        rows: list[tuple] = [pending] if pending is not None else []
        chars = 0
        for row in zip(*columns, strict=True):
            rows.append(row)
            chars += len(row[3])
            if chars >= SLICE_CHARS:
                yield finished(rows)
                rows, chars = rows[-1:], 0
        if len(rows) > 1:
            yield finished(rows)
        pending = rows[-1] if rows else pending


def _part(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted `bounds` are at most `value`, by halving."""
    listed = F.from_json(F.lit(str(bounds)), "array<bigint>")
    steps = [1 << i for i in range(max(1, len(bounds)).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(listed, at + step - 1) <= value, at + step).otherwise(at),
    )


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row by ascending id (null ids last), then by a hash of the text;
    the first row follows the last, and a single row follows itself. Rows go to parts of the id
    range, and each part also gets the first row of the next one. A null text is empty; equal
    texts have equal fingerprints; an empty one has the empty fingerprint, alike to itself only.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "hash", F.xxhash64("text")
    )
    count = docs.count()
    if count == 0:
        return rows.mapInArrow(_fingerprints, RESULT)
    parts = min(MAX_PARTS, math.ceil(count / PART_ROWS))
    cuts = (
        docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / parts for i in range(1, parts)], 20 * MAX_PARTS)).first()[0]
        if parts > 1
        else None
    )
    bounds = sorted(set(cuts or []))
    placed = rows.withColumn(
        "part", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(_part(F.col("doc_id"), bounds))
    )
    first = F.min(F.struct(F.col("doc_id"), F.col("hash"))).alias("first")
    heads = sorted((r["part"], r["first"]["doc_id"], r["first"]["hash"]) for r in placed.groupBy("part").agg(first).collect())
    targets = [(doc_id, hashed, heads[i - 1][0]) for i, (_, doc_id, hashed) in enumerate(heads)]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(targets, "head_id long, head_hash long, target int")
    extra = (
        rows.join(small(wanted), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("hash") == F.col("head_hash")))
        .select("doc_id", "text", "hash", F.col("target").alias("part"))
        .withColumn("extra", F.lit(True))
    )
    return (
        placed.withColumn("extra", F.lit(False))
        .unionByName(extra)
        .withColumn("none", F.col("doc_id").isNull())
        .repartition("part")
        .sortWithinPartitions("part", "extra", "none", "doc_id", "hash")
        .select("part", "extra", "doc_id", "text")
        .mapInArrow(_fingerprints, RESULT)
    )


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, anchor) of every closed syncmer, for matching passages by position."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids = batch.column("id").slice(at, 200)
                text, position, hashes = anchors_of([t or "" for t in batch.column("text").slice(at, 200).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text)), pa.array(position), pa.array(hashes.view(np.int64))],
                    names=["id", "position", "anchor"],
                )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, position long, anchor long")
