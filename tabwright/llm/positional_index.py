"""Phrase and proximity search by a positional inverted index; benchmark decontamination with it.

Only DataFrame functions. The corpus is read word by word: first to count the test terms, then to
store the postings (row, position, term) of the rarest ones. Each window of a test item starts from
the postings of its rarest term, moved back by the term's offset, and is intersected with those of
the second and third rarest. What is left are few diagonals (row, item, offset); on these all
postings of the row are intersected with all words of the item, and runs that fill a window are
exact matches. Rows are known by two 64-bit hashes, of the id and of the text, so null and repeated
ids need no special case.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.store import keep, small

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW_WORDS = 10
ROW = ["k1", "k2"]


def _lower(word: Column) -> Column:
    """A-Z to a-z and nothing else; the slow way only for words with any capital."""
    return F.when(F.lower(word) == word, word).otherwise(
        F.translate(word, string.ascii_uppercase, string.ascii_lowercase)
    )


def _pieces(text: Column) -> Column:
    return F.split(text, WORD_GAP)


def n_words(text: Column) -> Column:
    """Number of words; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.xxhash64(id_col).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))


def _postings(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(k1, k2, pos, term) of the words listed in `terms` (word, term)."""
    spread = rows.select(*ROW, F.posexplode(_pieces(F.col("text"))).alias("pos", "piece"))
    return (
        spread.withColumn("word", _lower(F.col("piece")))
        .join(terms.select("word", "term"), "word")
        .select(*ROW, "pos", "term")
    )


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, ipos, word, term, length) of every test item that has words."""
    text = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(_pieces(text), lambda w: w != "")
    return (
        items.select(F.col(id_col).alias("item_id"), words.alias("words"))
        .where(F.size("words") > 0)
        .distinct()
        .select(
            F.xxhash64("item_id", "words").alias("item"),
            "item_id",
            F.size("words").alias("length"),
            F.posexplode("words").alias("ipos", "word"),
        )
        .withColumn("term", F.xxhash64("word"))
    )


def _plans(words: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """For each anchor (an item's word that is the rarest of some window) the next two to intersect."""
    held = words.join(counts, "term", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    last = F.greatest(F.col("length") - window, F.lit(0))
    windows = held.withColumn(
        "start", F.explode(F.sequence(F.greatest(F.col("ipos") - window + 1, F.lit(0)), F.least(F.col("ipos"), last)))
    )
    place = Window.partitionBy("item", "start").orderBy("held", "term", "ipos")
    ranked = windows.withColumn("rank", F.row_number().over(place)).where("rank <= 3")
    one = lambda name, rank: F.max(F.when(F.col("rank") == rank, F.col(name)))
    return (
        ranked.groupBy("item", "start")
        .agg(
            F.min("held").alias("least"),
            *[one(name, rank).alias(f"{name}{rank}") for rank in (1, 2, 3) for name in ("ipos", "term")],
        )
        .where("least > 0")
        .drop("start", "least")
        .distinct()
    )


def diagonals(docs: DataFrame, words: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, item, delta): rows where the rarest terms of one of the item's windows lie right.

    delta is where the item's first word would lie; below 0 if the row begins inside the item.
    """
    rows = _rows(docs, id_col, text_col)
    terms = small(keep(words.select("word", "term").distinct()))
    counts = keep(_postings(rows, terms).groupBy("term").agg(F.count("*").alias("held")))
    plans = keep(_plans(words, counts, window))
    rare = plans.select(F.explode(F.array("term1", "term2", "term3")).alias("term")).distinct()
    index = keep(_postings(rows, small(keep(terms.join(rare, "term", "left_semi")))))
    found = (
        index.join(small(plans.withColumnRenamed("term1", "term")), "term")
        .withColumn("delta", F.col("pos") - F.col("ipos1"))
        .select(*ROW, "item", "delta", "ipos2", "term2", "ipos3", "term3")
        .distinct()
    )
    for rank in (2, 3):
        listed = index.join(
            small(plans.select(F.col(f"term{rank}").alias("term")).distinct()), "term", "left_semi"
        ).select(*ROW, F.col("pos").alias("at"), F.col("term").alias(f"term{rank}"))
        met = found.withColumn("at", F.col("delta") + F.col(f"ipos{rank}")).join(
            listed.distinct(), [*ROW, "at", f"term{rank}"]
        )
        short = found.where(F.col(f"term{rank}").isNull())
        columns = [c for c in found.columns if c not in (f"ipos{rank}", f"term{rank}")]
        found = met.select(columns).unionByName(short.select(columns)).distinct()
    return keep(found.select(*ROW, "item", "delta").distinct())


def phrase_matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Exact matches of any `window` consecutive words of an item, joined to the longest runs.

    Returns k1, k2 (the row), item_id, start (position of the first word), words (length of the
    run). An item of fewer words is matched whole; one without words, or a null text, matches
    nothing. Repeated items and rows change nothing but the number of rows they are found in.
    """
    words = keep(item_words(items, item_id_col, item_text_col))
    found = diagonals(docs, words, window, id_col, text_col)
    rows = _rows(docs, id_col, text_col).join(found.select(*ROW).distinct(), ROW, "left_semi")
    terms = small(keep(words.select("word", "term").distinct()))
    index = _postings(rows, terms).distinct()
    expected = found.join(small(words.select("item", "item_id", "ipos", "term", "length")), "item").withColumn(
        "pos", F.col("delta") + F.col("ipos")
    )
    met = expected.join(index, [*ROW, "pos", "term"]).select(*ROW, "item", "item_id", "delta", "ipos", "pos", "length")
    run = Window.partitionBy(*ROW, "item", "delta").orderBy("ipos")
    return (
        met.withColumn("run", F.col("ipos") - F.row_number().over(run))
        .groupBy(*ROW, "item", "item_id", "delta", "run", "length")
        .agg(F.min("pos").alias("start"), F.count("*").alias("words"))
        .where(F.col("words") >= F.least(F.col("length"), F.lit(window)))
        .select(*ROW, "item_id", "start", "words")
    )


def proximity_matches(
    docs: DataFrame,
    items: DataFrame,
    span: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Places where all distinct words of an item lie, in any order, within `span` consecutive words.

    Returns k1, k2, item_id, start (first word of such a stretch), one row per stretch. Search
    starts from the postings of each item's rarest word. Null and empty texts match nothing.
    """
    words = keep(item_words(items, item_id_col, item_text_col))
    rows = _rows(docs, id_col, text_col)
    index = keep(_postings(rows, small(words.select("word", "term").distinct())).distinct())
    held = index.groupBy("term").agg(F.count("*").alias("held"))
    needed = words.select("item", "item_id", "term").distinct()
    order = Window.partitionBy("item").orderBy("held", "term")
    ranked = needed.join(held, "term", "left").withColumn("rank", F.row_number().over(order))
    ranked = keep(ranked.withColumn("terms", F.max("rank").over(Window.partitionBy("item"))))
    center = index.join(small(ranked.where("rank = 1").select("item", "item_id", "term", "terms")), "term").select(
        *ROW, "item", "item_id", "terms", F.col("pos").alias("center")
    )
    center = center.withColumn("block", F.explode(F.sequence(F.col("center") - span + 1, F.col("center"))))
    others = index.join(small(ranked.select("item", "term")), "term").select(*ROW, "item", "term", "pos")
    others = others.withColumn("block", F.explode(F.sequence(F.col("pos") - span + 1, F.col("pos"))))
    return (
        center.join(others, [*ROW, "item", "block"])
        .groupBy(*ROW, "item", "item_id", "terms", "block")
        .agg(F.countDistinct("term").alias("met"))
        .where("met = terms and block >= 0")
        .select(*ROW, "item_id", F.col("block").alias("start"))
        .distinct()
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: its id, n_words, n_hit (words inside matches), item_ids (sorted strings).

    A null or empty text has no words and no hits. Other columns are not read. Empty items hit
    nothing; an empty `docs` gives no rows.
    """
    matches = keep(phrase_matches(docs, items, window, id_col, text_col, item_id_col, item_text_col))
    hit = (
        matches.select(
            *ROW, F.explode(F.sequence(F.col("start"), (F.col("start") + F.col("words") - 1).cast("int"))).alias("pos")
        )
        .distinct()
        .groupBy(*ROW)
        .agg(F.count("*").alias("n_hit"))
    )
    named = matches.groupBy(*ROW).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    text = F.col(text_col).cast("string")
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(id_col).alias("k1"),
        F.xxhash64(text).alias("k2"),
        n_words(text).alias("n_words"),
    )
    return own.join(hit.join(named, ROW), ROW, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
