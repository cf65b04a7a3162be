"""One query per operator over its whole table; each next to its SQL where SQL can express it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import (
    chat_format,
    co_training,
    context_mixing,
    language_id,
    piece_merges,
    piece_model,
    syncmers,
    toxicity,
)
from tabwright.llm.budget_mix import mix
from tabwright.llm.filter_audit import filter_audit
from tabwright.llm.jaccard_join import Similarity, jaccard_join
from tabwright.llm.phrase_mining import collocations
from tabwright.llm.pii_surrogates import pseudonymize
from tabwright.llm.positional_index import contamination
from tabwright.llm.texts import id_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id),
linked AS (SELECT x, y, c = n AND c = m AS same FROM shared WHERE 100 * c >= 90 * (n + m - c)),
links AS (SELECT x AS a, y AS b, same FROM linked UNION ALL SELECT y, x, same FROM linked),
parts(id, root) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT l.a, min(p.root) FROM parts p JOIN links l ON l.b = p.id JOIN recurring.parts r ON r.id = l.a
  WHERE p.root < r.root GROUP BY l.a),
counted AS (SELECT a, count(*) AS n, min(CASE WHEN same THEN b END) AS twin FROM links GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, p.root AS component_id,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(s.doc_id, coalesce(c.twin, s.doc_id)) AS class_id
FROM sets s JOIN parts p ON p.id = s.doc_id LEFT JOIN counted c ON c.a = s.doc_id
"""


@query("op6_jaccard_join", JACCARD_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(table(spark, folder, "documents"), Similarity(words=3, percent=90))


CONTAMINATION_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, s, s + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM doc_words, sizes WHERE len(w) >= n)),
met AS (SELECT d.doc_id, d.s, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.win = i.win),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM met) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op8_positional_index", CONTAMINATION_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").withColumn(
        "held_out", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    )
    model = language_id.fit(documents.where(~F.col("held_out")), "text", "lang")
    return language_id.predict(documents, model, "text", ("doc_id", "held_out"))


@query("op5_budget_mix")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"), weights=(3, 1, 2), share=1.5)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op2_pii_surrogates")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return pseudonymize(documents, key="op2-production-key", count_col="n_replaced")


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        "doc_id", "text", F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    )
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    # Labels grow with the documents: the same join by shuffle at every size.
    taught = documents.where(~F.col("held_out")).join(labels.hint("merge"), "doc_id")
    model = toxicity.fit(taught.select("text", "label"))
    scored = toxicity.score(documents, model, ("doc_id", "held_out"))
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "found", "n_words"
    )


@query("op3_syncmers")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.edit_fingerprints(table(spark, folder, "documents"))


@query("op7_context_mixing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").withColumn(
        "held_out", F.coalesce(id_remainder("doc_id", 5) == 1, F.lit(False))
    )
    return context_mixing.score(documents, documents.where(~F.col("held_out")), ("doc_id", "held_out"))


HARD_SAYING = r"\### Assistant: </turn> ok"


@query("op9_chat_format")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select(
        "conv_id", F.to_json(F.struct("turn", "role", "text")).alias("record")
    )
    said = [{"role": role, "content": HARD_SAYING} for role in ("user", "assistant")]
    hard = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(json.dumps({"messages": said})).alias("record"))
    turns = chat_format.canonical_turns(rows.unionByName(hard))
    return chat_format.read_back(chat_format.formatted_turns(turns))


@query("op10_co_training")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    documents, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    model = co_training.fit(co_training.sample_rows(documents, pages, labels.where(~held_out)))
    return co_training.score(documents, pages, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "text_score",
        "page_score",
    )


@query("op11_piece_merges")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers  # only this query needs the vocabulary files

    model = piece_model.load(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = piece_merges.encode(table(spark, folder, "documents").select("doc_id", "text"), model).drop("text")
    return piece_merges.decode(encoded, model).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sized AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM words),
occurring AS (
  SELECT lang, k, list_slice(w, s, s + k - 1) AS p
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM sized WHERE len(w) >= k)),
counts AS (SELECT lang, k, p, CAST(count(*) AS HUGEINT) AS f FROM occurring GROUP BY lang, k, p),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, p, f AS a FROM counts WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, k, p, a, unnest(generate_series(1, k - 1)) AS c FROM candidates),
cut_scores AS (
  SELECT u.lang, u.p, u.k, u.a, u.c, x.f AS l, y.f AS r, (2000000 * u.a) // (x.f + y.f) AS score
  FROM cuts u
  JOIN counts x ON x.lang = u.lang AND x.p = list_slice(u.p, 1, u.c)
  JOIN counts y ON y.lang = u.lang AND y.p = list_slice(u.p, u.c + 1, u.k)),
lowest AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
inside AS (
  SELECT lang, a, list_slice(p, s, s + m - 1) AS p
  FROM (SELECT lang, p, a, m, unnest(generate_series(1, k - m + 1)) AS s
        FROM (SELECT lang, p, a, k, unnest(generate_series(2, k - 1)) AS m FROM candidates WHERE k > 2))),
around AS (SELECT lang, p, max(a) AS f FROM inside GROUP BY lang, p),
ranked AS (
  SELECT l.lang, array_to_string(l.p, ' ') AS phrase, l.a, l.l, l.r, l.score,
         row_number() OVER (PARTITION BY l.lang ORDER BY l.score DESC, l.a DESC, encode(array_to_string(l.p, ' '))) AS rank
  FROM lowest l LEFT JOIN around o ON o.lang = l.lang AND o.p = l.p
  WHERE o.f IS NULL OR 100 * o.f < 80 * l.a)
SELECT r.lang, CAST(r.rank AS BIGINT) AS rank, r.phrase, CAST(r.a AS BIGINT) AS a, CAST(r.l AS BIGINT) AS l,
       CAST(r.r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""


@query("op12_phrase_mining", COLLOCATION_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


FILTER_AUDIT_SQL = r"""
WITH RECURSIVE
texts AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS t,
         regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(l.quality = 1, FALSE) AS good, coalesce(l.toxic = 1, FALSE) AS toxic
  FROM documents d LEFT JOIN labels l USING (doc_id)),
masks AS (
  SELECT part, good, toxic,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)::INT AS mask
  FROM texts),
cells AS (
  SELECT part, mask, count(*) AS docs, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM masks GROUP BY part, mask),
filters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
steps AS (
  SELECT letter AS prefix, letter, 1 AS step, bit, 0 AS before, bit AS applied FROM filters
  UNION ALL
  SELECT s.prefix || f.letter, f.letter, s.step + 1, f.bit, s.applied, s.applied | f.bit
  FROM steps s JOIN filters f ON s.applied & f.bit = 0),
counted AS (
  SELECT part, prefix, letter, step,
         sum(CASE WHEN mask & applied = 0 THEN docs ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN docs ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN docs ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN docs ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL),
ordered AS (
  SELECT c.*, o.prefix AS filter_order
  FROM counted c JOIN (SELECT DISTINCT prefix FROM steps WHERE step = 5) o ON c.prefix = left(o.prefix, c.step))
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM ordered
"""


@query("op13_filter_audit", FILTER_AUDIT_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
