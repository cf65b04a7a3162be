"""Weighted word features of free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.session import written

MAX_TERMS = 200
MAX_SHARE = 0.95
# A word is two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"
# Common English words left out of the features.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being "
    "below between both but by can cannot could did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it "
    "its itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your yours yourself yourselves"
).split()


def terms(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words and two-word phrases of a text, common words taken out first."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def _phrases() -> Column:
    """The two-word phrases of the words `w`."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))),
        lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)),
    )
    return F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>"))


def term_counts(df: DataFrame, key: str, text: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(key, term, tf) over whole texts; phrases are neighbours after common words are gone."""
    words = df.select(key, terms(F.col(text), stop_words).alias("w"))
    return (
        words.select(key, F.explode(F.concat("w", _phrases())).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vocabulary(
    counts: DataFrame, n_documents: int, max_terms: int = MAX_TERMS, max_share: float = MAX_SHARE, min_documents: int = 1
) -> DataFrame:
    """The most frequent terms that are not in nearly every text; ties go by the term."""
    return (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
        .where((F.col("df") <= max_share * n_documents) & (F.col("df") >= min_documents))
        .orderBy(F.desc("total"), "term")
        .limit(max_terms)
    )


def candidate_counts(
    df: DataFrame,
    key: str,
    text: str,
    n_documents: int,
    max_terms: int = MAX_TERMS,
    max_share: float = MAX_SHARE,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """The rows of `term_counts` of every term that can be in the `vocabulary`, and of a few others; exact.

    Terms are counted over all texts first, and only candidates are counted by text, which keeps the shuffles
    small. A word that is in few enough rows is in few enough texts, so the `max_terms`-th total of such
    words bounds the vocabulary from below; a phrase is no more frequent than either of its words.
    """
    words = written(df.select(F.col(key).alias("_key"), terms(F.col(text), stop_words).alias("w")))
    in_order = words.select(F.sort_array("w").alias("w"))
    marked = F.transform("w", lambda w, i: F.struct(w.alias("term"), F.when((i > 0) & (F.get("w", i - 1) == w), 0).otherwise(1).alias("first")))
    singles = written(
        in_order.select(F.inline(marked)).groupBy("term").agg(F.count(F.lit(1)).alias("total"), F.sum("first").alias("rows"))
    )
    rare = F.col("rows") <= max_share * n_documents
    top = singles.where(rare).orderBy(F.desc("total"), "term").limit(max_terms)
    found, least = top.agg(F.count(F.lit(1)), F.min("total")).first()
    bar = least if found == max_terms else 0
    frequent = written(singles.where(F.col("total") >= bar).select("term"))
    pairs = words.where(F.size("w") > 1).select(
        F.inline(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("a"), F.get("w", i).alias("b"))))
    )
    pairs = pairs.join(frequent.withColumnRenamed("term", "a"), "a", "left_semi").join(frequent.withColumnRenamed("term", "b"), "b", "left_semi")
    phrases = pairs.groupBy(F.concat_ws(" ", "a", "b").alias("term")).agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= bar)
    candidates = written(frequent.unionByName(phrases.select("term")))
    return (
        words.select("_key", F.explode(F.concat("w", _phrases())).alias("term"))
        .join(candidates, "term", "left_semi")
        .groupBy("_key", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
        .withColumnRenamed("_key", key)
    )


def tfidf(
    df: DataFrame,
    key: str,
    text: str,
    max_terms: int = MAX_TERMS,
    max_share: float = MAX_SHARE,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """(key, term, weight): tf * (ln((1+n)/(1+df)) + 1), each text scaled to length 1.

    The vocabulary holds `max_terms` rows, which bounds what is broadcast and what a text keeps.
    """
    n = df.count()
    counts = written(candidate_counts(df, key, text, n, max_terms, max_share, stop_words))
    chosen = vocabulary(counts, n, max_terms, max_share)
    weighted = counts.join(F.broadcast(chosen.select("term", "df")), "term").withColumn(
        "raw", F.col("tf") * (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1)
    )
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("raw") / length).alias("weight"))


def text_matrix(weights: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """One row per text with a column tfidf_i per vocabulary term, 0 where the term is absent."""
    summed = weights.repartition(key).groupBy(key, "term").agg(F.sum("weight").alias("weight"))
    known = F.when(F.col("term").isin(list(names)), F.struct("term", "weight"))
    rows = summed.groupBy(key).agg(F.map_from_entries(F.collect_list(known)).alias("_weights"))
    picks = [F.coalesce(F.element_at("_weights", F.lit(t)), F.lit(0.0)).alias(f"tfidf_{i}") for i, t in enumerate(names)]
    return rows.select(key, *picks)
