"""Mixing sources to target weights: exact word budgets by subset sums over document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.store import keep

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 1_000
CAP = 2
SLACK = 65_536
SEED = 20_240_501


def draw_of(id_col: str, text_col: str, seed: int = SEED) -> Column:
    """The hash of id and text by which documents are picked."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.md5(F.col(text_col).cast("string")))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered_sources(sources: DataFrame) -> DataFrame:
    """`sources` with their place (from 0) by code point of the name, null last.

    Ranges of names are numbered inside, then moved up by the sources before; only one count per
    range goes to the driver.
    """
    ordered = keep(
        sources.withColumn("last", F.col("source").isNull())
        .repartitionByRange("last", "source")
        .sortWithinPartitions("last", "source")
        .withColumn("range", F.spark_partition_id())
    )
    counts = {row["range"]: row["n"] for row in ordered.groupBy("range").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets += [F.lit(part), F.lit(before)]
        before += counts[part]
    inside = F.row_number().over(Window.partitionBy("range").orderBy("last", "source")) - 1
    place = inside + (F.element_at(F.create_map(*offsets), F.col("range")) if offsets else F.lit(0))
    return ordered.withColumn("place", place).drop("last", "range")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """`source, source_size` with `target`: the budget (`share` times all sizes) split by weight.

    No target passes CAP times its source's size; the excess goes to the others by weight until
    none is above. Each round is one small aggregation, and a source once capped stays capped.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = keep(_numbered_sources(sources).withColumn("weight", weight).withColumn("cap", CAP * F.col("source_size")))
    budget = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    rate = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * rate
        held, free = table.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        fresh = (budget - float(held or 0)) / free
        if fresh <= rate:
            break
        rate = fresh
    full = F.col("cap") <= F.col("weight") * rate
    return table.select(
        "source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * rate).alias("target")
    )


def fill_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size (at most `counts`) to take so that their words come to `budget`.

    First the same share of every size, then one more of each size from the largest while far
    from the budget; what remains is a bounded knapsack over the left-over counts: all sums up to
    the remainder and a little beyond are marked size by size, in powers of two of each count,
    with the size that first reached a sum. The sum nearest to the remainder wins, the smaller of
    two. Sizes of 0 are never taken; they add nothing.
    """
    taken = np.zeros(len(sizes), dtype=np.int64)
    total = int(sizes @ counts)
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return np.where(sizes > 0, counts, 0)
    taken = (counts * (budget / total)).astype(np.int64)
    rest = budget - int(sizes @ taken)
    for i in np.argsort(-sizes, kind="stable"):
        if sizes[i] > 0 and taken[i] < counts[i] and rest - sizes[i] >= SLACK:
            more = min(int(counts[i] - taken[i]), int((rest - SLACK) // sizes[i]))
            taken[i] += more
            rest -= more * int(sizes[i])
    if rest <= 0:
        return taken
    spare = counts - taken
    usable = np.flatnonzero((spare > 0) & (sizes > 0) & (sizes < 2 * rest))
    top = 2 * rest
    reach = np.zeros(top + 1, dtype=bool)
    reach[0] = True
    via = np.full(top + 1, -1, dtype=np.int32)
    steps: list[tuple[int, int]] = []
    for i in usable.tolist():
        size, many, batch = int(sizes[i]), min(int(spare[i]), top // int(sizes[i])), 1
        while many > 0:
            batch = min(batch, many)
            jump = size * batch
            if jump <= top:
                fresh = reach[: top + 1 - jump] & ~reach[jump:]
                via[jump:][fresh] = len(steps)
                reach[jump:] |= reach[: top + 1 - jump].copy()
            steps.append((i, batch))
            many -= batch
            batch *= 2
        if reach[rest]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at > 0:
        i, batch = steps[via[at]]
        taken[i] += batch
        at -= int(sizes[i]) * batch
    return taken


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", kind="stable").reset_index(drop=True)
    sizes, counts = rows["size"].to_numpy(), rows["n"].to_numpy()
    target = float(rows["target"].iloc[0])
    whole = int(min(CAP, target // max(1.0, float(sizes @ counts)))) if (sizes @ counts) else 0
    extra = fill_budget(sizes, counts, round(target) - whole * int(sizes @ counts)) if whole < CAP else counts * 0
    return rows.assign(whole=whole, extra=extra)[["source", "size", "whole", "extra"]]


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (size times copies),
    draw (the hash that picked it, of id and text).

    Documents are counted by exact length and source; lengths and counts of one source meet in one
    task, never its documents. The chosen number of each length goes to the documents with the
    smallest seeded hash: a large cell is cut into hashed buckets, whole buckets are taken in
    order, and only the last one is ranked. A null text has size 0; a null source is a source;
    repeated rows and ids count as documents each. Empty tables give no rows.
    """
    own = keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            n_words(F.col(text_col).cast("string")).alias("size"),
            draw_of(id_col, text_col, seed).alias("draw"),
        )
    )
    cells = keep(own.groupBy("source", "size").agg(F.count("*").alias("n")))
    wanted = keep(
        targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share)
    )
    joined = cells.alias("c").join(wanted.alias("w"), F.col("c.source").eqNullSafe(F.col("w.source")))
    plan = (
        joined.select("c.source", "c.size", "c.n", "w.target")
        .groupBy("source")
        .applyInPandas(_plan, "source string, size long, whole long, extra long")
    )
    return _chosen(own, cells, plan, wanted)


def _chosen(own: DataFrame, cells: DataFrame, plan: DataFrame, wanted: DataFrame) -> DataFrame:
    """Copies of each document: its cell's whole copies, one more if its draw is among the smallest."""
    named = lambda df: df.withColumn("none", F.col("source").isNull()).withColumn(
        "source", F.coalesce("source", F.lit(""))
    )
    key = ["none", "source", "size"]
    cells = keep(
        named(cells)
        .join(named(plan), key)
        .withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS))
        .select(*key, "whole", "extra", "buckets")
    )
    placed = named(own).join(cells, key).withColumn("bucket", F.pmod(F.col("draw"), F.col("buckets")))
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        placed.groupBy(*key, "bucket", "extra")
        .agg(F.count("*").alias("held"))
        .withColumn("left", F.col("extra") - F.coalesce(F.sum("held").over(before), F.lit(0)))
        .select(*key, "bucket", "left")
    )
    rank = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("draw", "doc_id"))
    ranked = placed.join(quota, [*key, "bucket"]).withColumn(
        "copies", F.col("whole") + (rank <= F.col("left")).cast("long")
    )
    return ranked.join(named(wanted), key[:2]).select(
        "doc_id",
        F.when(~F.col("none"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        "draw",
    )
