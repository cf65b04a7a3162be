"""The corpus pipeline: documents in, a weighted training mix out, one operator per stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import language_id
from tabwright.llm.budget_mix import draw_of, mix
from tabwright.llm.jaccard_join import Similarity, jaccard_join
from tabwright.llm.pii_surrogates import pseudonymize
from tabwright.llm.positional_index import phrase_matches
from tabwright.llm.store import keep

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; the others get the predicted one as `lang`."""
    model = language_id.fit(docs, "text", "lang")
    found = language_id.predict(docs, model, "text", tuple(docs.columns))
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).select(
        *[F.col("lang_pred").alias("lang") if c == "lang" else c for c in docs.columns]
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component of 5-word shingle sets with a similarity of 0.8 stays.

    A document is an id with a text: rows that share an id but differ in text are decided each for
    itself, of rows alike in both one stays (the smallest in the other columns). Rows without an id stay.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.col("text").cast("string")))
    keyed = docs.withColumn("_key", key)
    found = jaccard_join(keyed, Similarity(words=5, percent=80), id_col="_key").where("n_links > 0")
    linked = keep(found.select(F.col("doc_id").alias("_key"), "component_id").distinct())
    members = keep(keyed.select("doc_id", "_key").distinct().join(linked, "_key"))
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("first"))
    others = keep(
        members.join(first, "component_id").where(F.col("_key") != F.col("first._key")).select("_key").distinct()
    )
    repeated = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.count("*").alias("_rows"))
    repeated = keep(repeated.where("_rows > 1").select("_key"))
    left = keyed.join(others, "_key", "left_anti")
    once = left.join(repeated, "_key", "left_anti").select(docs.columns)
    again = left.join(repeated, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(again.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = keep(phrase_matches(docs, benchmark).select("k1", "k2").distinct())
    same = (F.xxhash64("doc_id") == F.col("k1")) & (F.xxhash64(F.col("text").cast("string")) == F.col("k2"))
    return docs.join(hit, same, "left_anti").select(docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become surrogates; `n_chars` follows the new text."""
    changed = pseudonymize(docs, key="corpus-pipeline")
    return changed.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with the number of copies it takes; those it takes no copy of go.

    Rows alike in id and text get the largest number of copies among them.
    """
    mixed = mix(docs, weights=(3, 1, 2), share=1.5).where("copies > 0")
    chosen = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("draw").alias("_draw")).agg(
        *[F.max(c).alias(c) for c in ("size", "source_size", "target", "copies", "taken")]
    )
    drawn = docs.withColumn("_own", draw_of("doc_id", "text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_draw"))
    return drawn.join(chosen, same).drop("_id", "_draw", "_own")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", replace_personal_data),
    ("source_mix", mix_sources),
]

# Phrase parsing, surrogates and subset sums have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each reading what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
