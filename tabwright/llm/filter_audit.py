"""What each of a set of document filters removes, in every order in which they can be applied.

A document fails some of the filters; only its set of failures, a mask of bits, decides what happens
to it in any order. Documents are therefore counted by (part, mask) first, and the orders are then
enumerated over masks alone: a recursive query starts from single filters, extends each prefix by the
letters it has not used yet, joins the mask cells and carries the bits applied so far. Its rows are
bounded by the number of filters, whatever the corpus holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.store import keep
from tabwright.llm.texts import portions, text_bytes

LETTERS = "ABCDE"
COPY_BIT = 16
UPPER_CASE = bytes(range(65, 91))
MOST_LETTERS = 7


@dataclass(frozen=True)
class Limits:
    """Bounds of the filters A to D: too few words, too few distinct ones, too many capitals, signs of markup."""

    least_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 3
    signs: bytes = b"#$%&*|"


def text_mask(text: bytes, points: int, limits: Limits) -> int:
    """Bits of the filters A (1), B (2), C (4) and D (8) that a text of `points` code points fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, UPPER_CASE))
    return (
        (len(words) < limits.least_words)
        | (100 * len(set(words)) < limits.distinct_percent * len(words)) << 1
        | (100 * capitals > limits.capital_percent * points) << 2
        | (len(text.translate(None, limits.signs)) < len(text)) << 3
    )


def measured(docs: DataFrame, limits: Limits, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask of A to D, digest of the text) of every document; a null text is empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = text_bytes(batch.column("text"))
            points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "part": batch.column("part"),
                    "mask": pa.array([text_mask(t, n, limits) for t, n in zip(texts, points, strict=True)], pa.int32()),
                    "digest": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                }
            )

    # Texts beside a null part count with the empty one.
    columns = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.col(text_col).cast("string").alias("text"),
    )
    id_type = columns.schema["id"].dataType.simpleString()
    return columns.mapInArrow(run, f"id {id_type}, part string, mask int, digest binary")


def failure_cells(
    docs: DataFrame,
    labels: DataFrame,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """Documents, good and toxic ones by (part, mask) under the filters A to E.

    E fails where a row with a smaller id has the same text, whatever its part. Rows that share the
    smallest id all pass E; a row without an id passes and makes no other fail. A null or empty text
    has no words, so it fails A and no other but E. Of several labels of an id one is enough. Extra
    columns are ignored. No documents give no rows.

    A text that very many rows share is counted per id before its group meets.
    """
    marks = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        )
    )
    rows = measured(docs, limits, id_col, text_col, part_col).join(marks, "id", "left")
    cell = ["digest", "mask", "part", "good", "toxic"]
    marked = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    per_id = marked.groupBy(*cell, "id").agg(F.count("*").alias("n"))
    has_id = F.col("id").isNotNull()
    per_cell = per_id.groupBy(*cell).agg(
        F.sum("n").alias("n"),
        F.min(F.when(has_id, F.struct("id", "n"))).alias("first"),
        F.sum(F.when(has_id, 0).otherwise(F.col("n"))).alias("nameless"),
    )
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    passing = F.col("nameless") + F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("mask").alias("mask"), passing.alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(COPY_BIT)).alias("mask"), (F.col("n") - passing).alias("n")),
    )
    split = per_cell.withColumn("smallest", smallest).select("part", "good", "toxic", F.inline(sides))

    def marked_sum(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))

    return (
        split.where("n > 0")
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("docs"), marked_sum("good").alias("good"), marked_sum("toxic").alias("toxic"))
    )


def enumeration_sql(letters: str) -> str:
    """Recursive query over masks: a row per (prefix of distinct letters, mask) with that step's outcome."""
    bits = ", ".join(f"('{letter}', {1 << i})" for i, letter in enumerate(letters))
    last = (1 << len(letters)) - 1
    return f"""
WITH RECURSIVE
filters AS (SELECT * FROM VALUES {bits} AS t(letter, bit)),
mask_cells AS (SELECT letter, bit, explode(sequence(0, {last})) AS mask FROM filters),
steps(prefix, letter, step, mask, bit, before, applied) AS (
  SELECT letter, letter, 1, mask, bit, 0, bit FROM mask_cells
  UNION ALL
  SELECT concat(s.prefix, c.letter), c.letter, s.step + 1, s.mask, c.bit, s.applied, s.applied | c.bit
  FROM steps s JOIN mask_cells c ON s.mask = c.mask
  WHERE s.applied & c.bit = 0)
SELECT prefix, letter, step, mask,
       mask & applied = 0 AS is_kept,
       mask & bit <> 0 AND mask & before = 0 AS is_removed,
       mask & bit <> 0 AND mask & before <> 0 AS is_redundant,
       mask = bit AS is_unique
FROM steps
"""


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What every step of every filter order does in every part.

    `cells`: (part, mask, docs, good, toxic); bit i of a mask means a failure of letters[i]. One row
    per (part, filter_order, step), zeros included: `kept` after the step, `removed` by it,
    `redundant` (fail it, but were removed before), `unique_fails` (fail it alone), `good_lost` and
    `toxic_lost` among the removed, and `shapley`, what the step's filter removes summed over all
    orders. Repeated cells add up; a null part counts as the empty one; no cells give no rows. More
    than seven letters, or a letter used twice, raise.
    """
    if not 0 < len(letters) <= MOST_LETTERS or len(set(letters)) < len(letters) or not letters.isalpha():
        raise ValueError(f"filters are one to {MOST_LETTERS} distinct letters")
    spark = cells.sparkSession
    outcome = keep(spark.sql(enumeration_sql(letters)))
    own = keep(
        cells.groupBy(F.coalesce("part", F.lit("")).alias("part"), "mask").agg(
            *[F.sum(c).alias(c) for c in ("docs", "good", "toxic")]
        )
    )

    def total(flag: str, count: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(count)).otherwise(0)).cast("long")

    step_counts = (
        own.join(outcome, "mask")
        .groupBy("part", "prefix", "letter", "step")
        .agg(
            total("is_kept", "docs").alias("kept"),
            total("is_removed", "docs").alias("removed"),
            total("is_redundant", "docs").alias("redundant"),
            total("is_unique", "docs").alias("unique_fails"),
            total("is_removed", "good").alias("good_lost"),
            total("is_removed", "toxic").alias("toxic_lost"),
        )
    )
    orders = (
        outcome.where((F.col("step") == len(letters)) & (F.col("mask") == 0))
        .select(F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("at"))
        .select("filter_order", F.expr("left(filter_order, at)").alias("prefix"))
    )
    return (
        step_counts.join(orders, "prefix")
        .withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
        .drop("prefix", "letter")
    )


def filter_audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`audit` over the documents' failures of the filters A to E."""
    return audit(failure_cells(docs, labels, limits))
