"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.store import keep


def _shape(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a set of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Alternating stars: each node hands the smallest neighbour to the larger ones, then to the
    smaller ones, until every node points at its root. Rounds grow with the logarithm of the
    longest path. Minima are merged before the shuffle, so a node with very many edges is no
    burden; the joins back are plain ones, which adaptive execution splits. Empty edges give an
    empty result; loops and repeated edges change nothing; null ends are left out.
    """
    current = keep(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .distinct()
    )
    shape = _shape(current)
    while shape[0]:
        both = current.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
            current.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        )
        roots = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(roots, "high").where("low > m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        current = keep(small.unionByName(roots.select("high", F.col("m").alias("low"))).distinct())
        before, shape = shape, _shape(current)
        if shape == before:
            break
    tails = current.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return tails.unionByName(tails.select(F.col("component").alias("node"), "component").distinct())
