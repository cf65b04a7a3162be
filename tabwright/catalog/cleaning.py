"""Cleaning and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, spread_table, sql_order_stat, table
from tabwright.catalog.profiling import BLANKED_COLUMNS, SQL_BLANKED, blanked, rounded
from tabwright.catalog.quality import _scan_sql, sql_bounds
from tabwright.operators import clean as C
from tabwright.operators import scan as S

SKEWED = ["l_quantity", "l_extendedprice", "heavy"]


def skewed(spark, folder):
    """lineitem with a long-tailed amount, so that fences have something to catch."""
    price = F.col("l_extendedprice")
    return spread_table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.when(F.col("l_linenumber") != 2, price * price).alias("heavy"),
    )


SQL_SKEWED = (
    "(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, "
    "CASE WHEN l_linenumber <> 2 THEN l_extendedprice * l_extendedprice END AS heavy FROM lineitem)"
)


@query("drop_duplicates_documents", "CLN-1", sql="SELECT DISTINCT md5(text) AS text_md5, lang FROM documents")
def drop_duplicates_documents(spark, folder):
    df = C.drop_duplicates(table(spark, folder, "documents").select("text", "lang"))
    return df.select(F.md5("text").alias("text_md5"), "lang")


_mode = (
    "(SELECT l_returnflag FROM {0} WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)".format(
        SQL_BLANKED
    )
)


def _filled_sql(discount: str, flag: str) -> str:
    return (
        f"SELECT l_orderkey, l_quantity, l_extendedprice, round(coalesce(l_discount, ({discount})), 8) AS l_discount, "
        f"coalesce(l_returnflag, {flag}) AS l_returnflag, l_linestatus FROM {SQL_BLANKED}"
    )


_median_discount = f"SELECT {sql_order_stat('l_discount', 0.5)} FROM {SQL_BLANKED}"
_mean_discount = f"SELECT avg(l_discount) FROM {SQL_BLANKED}"
_mode_discount = f"SELECT l_discount FROM {SQL_BLANKED} WHERE l_discount IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"
FILLED = {
    "auto": (_median_discount, _mode),
    "mean": (_mean_discount, _mode),
    "mode": (_mode_discount, _mode),
    "zero": ("SELECT 0.0", "''"),
}


def _filled(strategy):
    def run(spark, folder):
        df, _ = C.handle_missing(blanked(spark, folder), strategy)
        return df.withColumn("l_discount", F.round("l_discount", 8))

    return run


for _strategy, (_number, _word) in FILLED.items():
    query(f"fill_missing_{_strategy}", "CLN-2", "CLN-3", sql=_filled_sql(_number, _word))(_filled(_strategy))


@query(
    "fill_log", "CLN-3",
    sql=f"""
    SELECT 'l_discount' AS "column", count(*) - count(l_discount) AS n_filled, 'median' AS strategy,
      format('{{:.2f}}', ({_median_discount})) AS fill_value FROM {SQL_BLANKED}
    UNION ALL SELECT 'l_returnflag', count(*) - count(l_returnflag), 'mode', {_mode} FROM {SQL_BLANKED}
    """,
)
def fill_log(spark, folder):
    return C.handle_missing(blanked(spark, folder), "auto")[1]


@query(
    "fill_mean_then_zero", "CLN-12",
    sql=f"SELECT l_orderkey, round(coalesce(l_discount, ({_mean_discount}), 0), 8) AS l_discount FROM {SQL_BLANKED}",
)
def fill_mean_then_zero(spark, folder):
    df = blanked(spark, folder).select("l_orderkey", "l_discount")
    return C.fill_mean_then_zero(df, ["l_discount"]).withColumn("l_discount", F.round("l_discount", 8))


@query(
    "drop_missing_rows", "CLN-4",
    sql=f"SELECT * FROM {SQL_BLANKED} WHERE {' AND '.join(c + ' IS NOT NULL' for c in BLANKED_COLUMNS)}",
)
def drop_missing_rows(spark, folder):
    return C.drop_missing(blanked(spark, folder))


@query(
    "clip_outliers", "CLN-5", "FUN-4",
    sql=f"WITH b AS ({sql_bounds(SQL_SKEWED, SKEWED)}) SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"CASE WHEN s.{c} IS NOT NULL THEN greatest(lo_{c}, least(hi_{c}, s.{c})) END AS {c}" for c in SKEWED
    )
    + f" FROM {SQL_SKEWED} AS s, b",
)
def clip_outliers(spark, folder):
    return C.clip_outliers(skewed(spark, folder), SKEWED)[0]


_keep = " AND ".join(f"(s.{c} IS NULL OR s.{c} BETWEEN lo_{c} AND hi_{c})" for c in SKEWED)


@query(
    "remove_outliers_joint", "CLN-7",
    sql=f"WITH b AS ({sql_bounds(SQL_SKEWED, SKEWED)}) SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, "
    f"heavy FROM {SQL_SKEWED} AS s, b WHERE {_keep}",
)
def remove_outliers_joint(spark, folder):
    return C.remove_outliers(skewed(spark, folder), SKEWED)[0]


def _sequential_sql():
    steps, source = [], SQL_SKEWED
    for i, c in enumerate(("heavy", "l_extendedprice", "l_quantity")):
        steps.append(f"b{i} AS ({sql_bounds(source, [c])})")
        steps.append(
            f"s{i} AS (SELECT s.* FROM {source} AS s, b{i} WHERE s.{c} IS NULL OR lo_{c} = hi_{c} OR s.{c} BETWEEN lo_{c} AND hi_{c})"
        )
        source = f"s{i}"
    return f"WITH {', '.join(steps)} SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, heavy FROM {source}"


@query("remove_outliers_sequential", "CLN-6", sql=_sequential_sql())
def remove_outliers_sequential(spark, folder):
    df, _ = C.remove_outliers(skewed(spark, folder), ["heavy", "l_extendedprice", "l_quantity"], mode="sequential")
    return df


@query("drop_constant_columns", "CLN-8", sql="SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_constant_columns(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return C.drop_constants(df.withColumns({"always": F.lit(7), "empty": F.lit(None).cast("string")}))[0]


_unit = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "minmax_lineitem", "CLN-9",
    sql="WITH m AS (SELECT "
    + ", ".join(f"min({c}) AS lo_{c}, max({c}) - min({c}) AS w_{c}" for c in _unit)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - lo_{c}) / w_{c}, 4) AS {c}" for c in _unit)
    + " FROM lineitem, m",
)
def minmax_lineitem(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *_unit)
    return C.normalize(df, _unit)


def _scaled_sql(kind):
    pair = (
        "avg({0}) AS o_{0}, CASE WHEN stddev_pop({0}) = 0 THEN 1 ELSE stddev_pop({0}) END AS w_{0}"
        if kind == "standard"
        else "min({0}) AS o_{0}, CASE WHEN max({0}) = min({0}) THEN 1 ELSE max({0}) - min({0}) END AS w_{0}"
    )
    return (
        f"WITH t AS (SELECT *, 3.0::DOUBLE AS flat FROM lineitem), m AS (SELECT {', '.join(pair.format(c) for c in [*_unit, 'flat'])} FROM t) "
        f"SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - o_{c}) / w_{c}, 6) + 0.0 AS {c}' for c in [*_unit, 'flat'])} FROM t, m"
    )


def _scaled(kind):
    def run(spark, folder):
        df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *_unit, F.lit(3.0).alias("flat"))
        out = C.apply_scale(df, C.fit_scale(df, [*_unit, "flat"], kind))
        return rounded(out, *_unit, "flat")

    return run


for _kind in ("standard", "minmax"):
    query(f"scale_{_kind}", "CLN-10", sql=_scaled_sql(_kind))(_scaled(_kind))


@query(
    "apply_scale_to_new_rows", "CLN-11",
    sql="""
    WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_linestatus = 'F')
    SELECT l_orderkey, l_linenumber, round((l_quantity - a) / s, 6) + 0.0 AS l_quantity FROM lineitem, m WHERE l_linestatus = 'O'
    """,
)
def apply_scale_to_new_rows(spark, folder):
    df = table(spark, folder, "lineitem")
    scales = C.fit_scale(df.where("l_linestatus = 'F'"), ["l_quantity"])
    fresh = df.where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(C.apply_scale(fresh, scales), "l_quantity")


@query(
    "prepare_numeric", "CLN-13",
    sql=f"""
    WITH f AS (SELECT l_orderkey, l_quantity, coalesce(l_discount, ({_median_discount})) AS l_discount FROM {SQL_BLANKED}),
    m AS (SELECT avg(l_quantity) AS aq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS ad, stddev_pop(l_discount) AS sd FROM f)
    SELECT l_orderkey, round((l_quantity - aq) / sq, 6) + 0.0 AS l_quantity, round((l_discount - ad) / sd, 6) + 0.0 AS l_discount,
      (SELECT count(*) - count(l_discount) FROM {SQL_BLANKED}) AS n_filled FROM f, m
    """,
)
def prepare_numeric(spark, folder):
    df = blanked(spark, folder).select("l_orderkey", "l_quantity", "l_discount")
    ready = C.prepare_numeric(df, ["l_quantity", "l_discount"])
    out = rounded(ready.table, "l_quantity", "l_discount")
    return out.withColumn("n_filled", F.lit(ready.n_filled).cast("long"))


_before = _scan_sql(SQL_BLANKED, BLANKED_COLUMNS[:4], BLANKED_COLUMNS[4:])
_cleaned = f"(SELECT DISTINCT * FROM ({_filled_sql(_median_discount, _mode)}))"
_after = _scan_sql(_cleaned, BLANKED_COLUMNS[:4], BLANKED_COLUMNS[4:])


@query(
    "scan_before_and_after", "CLN-15",
    sql=f"SELECT *, 'before' AS stage FROM ({_before}) UNION ALL SELECT *, 'after' AS stage FROM ({_after})",
)
def scan_before_and_after(spark, folder):
    df = blanked(spark, folder).select(*BLANKED_COLUMNS)
    return S.compare_scans(df, C.drop_duplicates(C.handle_missing(df, "auto")[0]))
