"""Outliers, quality scores and preprocessing advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, spread_table, sql_order_stat, table
from tabwright.catalog.profiling import BLANKED_COLUMNS, MEASURES, SQL_BLANKED, blanked, rounded
from tabwright.functions.statistics import order_stats
from tabwright.operators import scan as S
from tabwright.operators import targets as G

HALF = "1.5"


def sql_bounds(source: str, columns: list[str], factor: str = HALF) -> str:
    """One row (lo_c, hi_c per column) of quartile fences; NULL fences under four values."""
    quartiles = ", ".join(
        f"{sql_order_stat(c, 0.25)}::DOUBLE AS q1_{c}, {sql_order_stat(c, 0.75)}::DOUBLE AS q3_{c}, count({c}) AS n_{c}"
        for c in columns
    )
    fences = ", ".join(
        f"CASE WHEN n_{c} >= 4 THEN q1_{c} - {factor}::DOUBLE * (q3_{c} - q1_{c}) END AS lo_{c}, "
        f"CASE WHEN n_{c} >= 4 THEN q3_{c} + {factor}::DOUBLE * (q3_{c} - q1_{c}) END AS hi_{c}"
        for c in columns
    )
    return f"SELECT *, {fences} FROM (SELECT {quartiles} FROM {source})"


@query(
    "order_stats_lineitem", "AGG-4",
    sql=" UNION ALL ".join(
        f"SELECT '{c}' AS name, {p}::DOUBLE AS p, {sql_order_stat(c, p)} AS value FROM lineitem"
        for c in MEASURES for p in (0.25, 0.5, 0.75)
    ),
)
def order_stats_lineitem(spark, folder):
    found = order_stats(spread_table(spark, folder, "lineitem"), {c: (0.25, 0.5, 0.75) for c in MEASURES})
    return spark.createDataFrame(
        [(c, p, value) for c, values in found.items() for p, value in values.items()],
        "name string, p double, value double",
    )


@query(
    "iqr_outliers_lineitem", "PRO-6",
    sql=f"WITH b AS ({sql_bounds('lineitem', MEASURES)}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, round(lo_{c}, 6) AS low, round(hi_{c}, 6) AS high, "
        f"(SELECT count(*) FROM lineitem WHERE {c} < lo_{c} OR {c} > hi_{c}) AS n_outliers FROM b"
        for c in MEASURES
    ),
)
def iqr_outliers_lineitem(spark, folder):
    return rounded(S.outlier_counts(spread_table(spark, folder, "lineitem"), MEASURES), "low", "high")


def _scan_sql(source, numeric, words, target=None):
    """The whole scan as one statement over an inline view."""
    columns = [*numeric, *words]
    p = len(columns)
    missing = " + ".join(f"(count(*) - count({c}))" for c in columns)
    distinct = ", ".join(columns)
    outliers = " + ".join(f"(SELECT count(*) FROM t WHERE {c} < lo_{c} OR {c} > hi_{c})" for c in numeric)
    constants = " + ".join(
        f"CASE WHEN count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1 THEN 1 ELSE 0 END" for c in columns
    )
    pairs = [
        f"CASE WHEN var_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) > 0 AND var_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0 "
        f"AND abs(corr({a}, {b})) > 0.9 THEN 1 ELSE 0 END"
        for i, a in enumerate(numeric)
        for b in numeric[i + 1 :]
    ]
    ranges = ", ".join(f"max({c})::DOUBLE - min({c})::DOUBLE" for c in numeric)
    imbalance = (
        f"(SELECT max(k) / sum(k) > 0.8 FROM (SELECT count(*) AS k FROM t WHERE {target} IS NOT NULL GROUP BY {target}))"
        if target
        else "false"
    )
    return f"""
    WITH t AS (SELECT {distinct} FROM {source}), b AS ({sql_bounds('t', numeric)}),
    a AS (SELECT count(*) AS n, {missing} AS miss, {constants} AS cons, {" + ".join(pairs) or 0} AS prs,
        list_filter([{ranges}], lambda v : v > 0) AS rs FROM t),
    d AS (SELECT a.n - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS dup FROM a),
    o AS (SELECT {outliers} AS outl FROM b),
    f AS (SELECT *, coalesce(len(rs) > 1 AND list_max(rs) / list_min(rs) > 100, false) AS wide, n < 100 AS small, {imbalance} AS imb FROM a, d, o),
    s AS (SELECT *, greatest(0, floor(100.5 - least(25, miss / (n * {p}) * 100) - least(15, dup / n * 50)
        - least(15, outl / (n * {max(len(numeric), 1)}) * 50) - 5 * cons - least(10, 2 * prs)
        - CASE WHEN small THEN 5 ELSE 0 END - CASE WHEN imb THEN 10 ELSE 0 END - CASE WHEN wide THEN 3 ELSE 0 END)) AS score FROM f)
    SELECT n AS n_rows, {p} AS n_columns, {len(numeric)} AS n_numeric, {len(words)} AS n_categorical, miss AS total_missing,
      dup AS duplicate_rows, outl AS total_outliers, cons AS constant_columns, prs AS high_correlations, wide AS scale_issue,
      small AS small_data, imb AS imbalanced, CAST(score AS BIGINT) AS score,
      (miss > 0)::INT + (dup > 0)::INT + (outl > 0)::INT + (cons > 0)::INT + (prs > 0)::INT + small::INT + imb::INT + wide::INT AS n_warnings,
      score >= 50 AS ready FROM s
    """


@query(
    "scan_score_customer", "PRO-11",
    sql=_scan_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"], "c_mktsegment"),
)
def scan_score_customer(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment")
    return S.scan(df, "c_mktsegment")


_blank_numeric = BLANKED_COLUMNS[:4]


@query("scan_score_blanked", "PRO-11", sql=_scan_sql(SQL_BLANKED, _blank_numeric, BLANKED_COLUMNS[4:], "l_linestatus"))
def scan_score_blanked(spark, folder):
    return S.scan(blanked(spark, folder).select(*BLANKED_COLUMNS), "l_linestatus")


@query(
    "recommendations_blanked", "PRO-16",
    sql=f"""
    WITH t AS (SELECT l_quantity, l_extendedprice, l_discount, l_quantity * 0 AS flat, l_returnflag,
        CAST(l_orderkey AS VARCHAR) AS order_text,
        CASE WHEN l_quantity > 48 THEN l_quantity * 1000 ELSE l_quantity END AS spiky FROM {SQL_BLANKED}),
    b AS ({sql_bounds('t', ['spiky', 'l_quantity', 'l_extendedprice', 'l_discount'])}),
    sh AS (SELECT {", ".join(f"(SELECT count(*) FILTER (WHERE {c} < lo_{c} OR {c} > hi_{c}) / count({c}) FROM t) AS s_{c}"
        for c in ('spiky', 'l_quantity', 'l_extendedprice', 'l_discount'))} FROM b),
    ol AS (SELECT list_filter([{", ".join(f"CASE WHEN s_{c} > 0.03 THEN '{c}' END" for c in ('l_discount', 'l_extendedprice', 'l_quantity', 'spiky'))}],
        lambda v : v IS NOT NULL) AS names, greatest(s_spiky, s_l_quantity, s_l_extendedprice, s_l_discount) AS worst FROM sh),
    m AS (SELECT (count(*) - count(l_discount)) / count(*) AS md, (count(*) - count(l_returnflag)) / count(*) AS mr FROM t),
    r AS (SELECT max(l_extendedprice) - min(l_extendedprice) AS re, max(l_discount) - min(l_discount) AS rd FROM t)
    SELECT 'missing' AS rule, 'medium' AS severity, 2 AS n_columns, 'l_discount|l_returnflag' AS columns, 'auto' AS action
      FROM m WHERE md > 0 AND mr > 0 AND md <= 0.3 AND mr <= 0.3
    UNION ALL SELECT 'outliers', CASE WHEN worst > 0.1 THEN 'high' ELSE 'medium' END, len(names), array_to_string(names, '|'), 'clip'
      FROM ol WHERE len(names) > 0
    UNION ALL SELECT 'scaling', 'medium', 5, 'flat|l_discount|l_extendedprice|l_quantity|spiky', 'standard' FROM r WHERE re / rd > 100
    UNION ALL SELECT 'cardinality', 'low', 1, 'order_text', 'exclude' FROM (SELECT count(DISTINCT order_text) AS k FROM t) WHERE k > 20
    UNION ALL SELECT 'variance', 'low', len(ns), array_to_string(ns, '|'), 'exclude' FROM (SELECT list_filter(
      [{", ".join(f"CASE WHEN var_pop({c}) < 0.001 THEN '{c}' END" for c in ('flat', 'l_discount', 'l_extendedprice', 'l_quantity', 'spiky'))}],
      lambda v : v IS NOT NULL) AS ns FROM t) WHERE len(ns) > 0
    """,
)
def recommendations_blanked(spark, folder):
    df = blanked(spark, folder).select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        (F.col("l_quantity") * 0).alias("flat"),
        "l_returnflag",
        F.col("l_orderkey").cast("string").alias("order_text"),
        F.when(F.col("l_quantity") > 48, F.col("l_quantity") * 1000).otherwise(F.col("l_quantity")).alias("spiky"),
    )
    return G.recommendations(df)
