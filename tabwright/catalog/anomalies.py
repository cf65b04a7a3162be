"""Unusual values and rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, spread_table, table
from tabwright.catalog.cleaning import SKEWED, SQL_SKEWED
from tabwright.catalog.learning import SQL_DISTANCE, embedded
from tabwright.catalog.profiling import rounded
from tabwright.catalog.quality import sql_bounds
from tabwright.operators import anomaly as A
from tabwright.operators.clean import apply_scale, fit_scale
from tabwright.operators.neighbors import as_vector


def tailed(spark, folder):
    """Events with the value and a long-tailed function of it."""
    return table(spark, folder, "events").select(
        "event_id", "value", (F.col("value") * F.col("value") * F.col("value")).alias("cube")
    )


SQL_TAILED = "(SELECT event_id, value, value * value * value AS cube FROM events)"
_z = "WITH t AS (SELECT * FROM " + SQL_TAILED + "), " + (
    "m AS (SELECT avg(value) AS a1, stddev_pop(value) AS s1, avg(cube) AS a2, stddev_pop(cube) AS s2 FROM t), "
    "h AS (SELECT event_id, 'value' AS \"column\", value, abs((value - a1) / s1) AS score FROM t, m WHERE s1 > 0 "
    "UNION ALL SELECT event_id, 'cube', cube, abs((cube - a2) / s2) FROM t, m WHERE s2 > 0), "
    "z AS (SELECT * FROM h WHERE score > 2.5)"
)


@query("zscore_events", "ANO-1", sql=_z + ' SELECT event_id, "column", value, round(score, 5) AS score FROM z')
def zscore_events(spark, folder):
    return rounded(A.zscore_anomalies(tailed(spark, folder), ["event_id"], ["value", "cube"], 2.5), "score", places=5)


_summary = """ SELECT count(DISTINCT event_id) AS n_anomalous, (SELECT count(*) FROM t) AS n_rows,
  round(count(DISTINCT event_id) / (SELECT count(*) FROM t), 6) AS rate,
  CASE WHEN count(DISTINCT event_id) / (SELECT count(*) FROM t) < 0.01 THEN 'clean'
    WHEN count(DISTINCT event_id) / (SELECT count(*) FROM t) < 0.05 THEN 'typical' ELSE 'high' END AS verdict FROM """


@query("zscore_summary", "ANO-3", sql=_z + _summary + "z")
def zscore_summary(spark, folder):
    df = tailed(spark, folder)
    return rounded(A.anomaly_summary(df, A.zscore_anomalies(df, ["event_id"], ["value", "cube"], 2.5), ["event_id"]), "rate")


_fenced = f"WITH t AS (SELECT * FROM {SQL_TAILED}), b AS ({sql_bounds('t', ['value', 'cube'])}), h AS (" + " UNION ALL ".join(
    f"SELECT event_id, '{c}' AS \"column\", {c} AS value, CASE WHEN {c} < lo_{c} THEN 'below' ELSE 'above' END AS bound "
    f"FROM t, b WHERE {c} < lo_{c} OR {c} > hi_{c}"
    for c in ("value", "cube")
)


@query("iqr_rows", "ANO-2", sql=_fenced + ") SELECT * FROM h")
def iqr_rows(spark, folder):
    return A.iqr_anomalies(tailed(spark, folder), ["event_id"], ["value", "cube"])


@query("iqr_per_column", "ANO-3", sql=_fenced + ') SELECT "column", count(*) AS n_anomalies FROM h GROUP BY 1')
def iqr_per_column(spark, folder):
    return A.anomalies_per_column(A.iqr_anomalies(tailed(spark, folder), ["event_id"], ["value", "cube"]))


@query("iqr_summary", "ANO-3", sql=_fenced + ")" + _summary + "h")
def iqr_summary(spark, folder):
    df = tailed(spark, folder)
    return rounded(A.anomaly_summary(df, A.iqr_anomalies(df, ["event_id"], ["value", "cube"]), ["event_id"]), "rate")


@query(
    "iqr_lines_with_blanks", "ANO-2",
    sql=f"""
    WITH b AS ({sql_bounds(SQL_SKEWED, SKEWED)}) SELECT l_orderkey, l_linenumber, 'heavy' AS "column", heavy AS value, 'above' AS bound
    FROM {SQL_SKEWED}, b WHERE heavy > hi_heavy
    """,
)
def iqr_lines_with_blanks(spark, folder):
    from tabwright.catalog.cleaning import skewed

    return A.iqr_anomalies(skewed(spark, folder), ["l_orderkey", "l_linenumber"], SKEWED)


def standard_points(df, key, columns):
    """Standardised number columns as points (id, vec)."""
    scaled = apply_scale(df, fit_scale(df, columns))
    return as_vector(scaled, columns).select(F.col(key).cast("long").alias("id"), "vec")


@query("isolation_forest_orders", "ANO-4")
def isolation_forest_orders(spark, folder):
    df = spread_table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("day")
    )
    return A.isolation_forest(standard_points(df, "o_orderkey", ["o_totalprice", "day"]))


_lof = f"""
    WITH d AS (SELECT a.vec_id AS id, b.vec_id AS neighbor, {SQL_DISTANCE} AS distance
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS rank FROM d),
    k AS (SELECT * FROM r WHERE rank <= 20),
    kd AS (SELECT id, max(distance) AS kd FROM k GROUP BY 1),
    l AS (SELECT k.id, 20 / sum(greatest(distance, kd)) AS lrd FROM k JOIN kd ON kd.id = k.neighbor GROUP BY 1),
    s AS (SELECT k.id, sum(o.lrd) / 20 / any_value(m.lrd) AS score FROM k JOIN l o ON o.id = k.neighbor JOIN l m ON m.id = k.id GROUP BY k.id)
"""


@query("lof_embeddings", "ANO-5", sql=_lof + "SELECT id, round(score, 6) AS score FROM s")
def lof_embeddings(spark, folder):
    return rounded(A.local_outlier_scores(embedded(spark, folder).select("id", "vec"), 20), "score")


@query(
    "lof_flagged", "ANO-5",
    sql=_lof
    + """, t AS (SELECT list_sort(list(score), 'DESC')[greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT))] AS threshold FROM s)
    SELECT count(*) AS n, count(*) FILTER (WHERE score >= threshold - 1e-12) AS n_anomalies FROM s, t""",
)
def lof_flagged(spark, folder):
    flagged = A.local_outliers(embedded(spark, folder).select("id", "vec"), 20)
    return flagged.agg(F.count("*").alias("n"), F.count_if("anomaly").alias("n_anomalies"))
