"""Learners whose answer has a closed form, and scoring with stored numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, table
from tabwright.catalog.profiling import rounded
from tabwright.operators import learners as L
from tabwright.operators import neighbors as N
from tabwright.operators.clean import apply_scale, fit_scale


@query(
    "baseline_mean_price", "SUP-1", "SCO-1",
    sql="SELECT o_orderkey, round((SELECT avg(o_totalprice) FROM orders), 4) AS prediction FROM orders",
)
def baseline_mean_price(spark, folder):
    df = table(spark, folder, "orders")
    model = L.fit_baseline(df, "o_totalprice", classification=False)
    return df.select("o_orderkey", F.round(model.predict([]), 4).alias("prediction"))


@query(
    "baseline_majority_segment", "SUP-1", "AGG-3",
    sql="""
    SELECT c_custkey, (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS prediction FROM customer
    """,
)
def baseline_majority_segment(spark, folder):
    df = table(spark, folder, "customer")
    model = L.fit_baseline(df, "c_mktsegment", classification=True)
    return df.select("c_custkey", model.predict([]).alias("prediction"))


@query(
    "cross_products_lineitem", "AGG-11",
    sql="SELECT * FROM (SELECT "
    + ", ".join(
        f"round(sum({a}::DOUBLE * {b}::DOUBLE) / count(*), 4) AS {n}"
        for n, a, b in (
            ("one_one", "1", "1"), ("one_qty", "1", "l_quantity"), ("one_tax", "1", "l_tax"),
            ("qty_qty", "l_quantity", "l_quantity"), ("qty_tax", "l_quantity", "l_tax"), ("tax_tax", "l_tax", "l_tax"),
            ("one_y", "1", "l_extendedprice"), ("qty_y", "l_quantity", "l_extendedprice"), ("tax_y", "l_tax", "l_extendedprice"),
        )
    )
    + " FROM lineitem)",
)
def cross_products_lineitem(spark, folder):
    df = table(spark, folder, "lineitem")
    gram, moment = L.cross_products(df, ["l_quantity", "l_tax"], "l_extendedprice")
    n = gram[0, 0]
    names = ["one", "qty", "tax"]
    cells = {f"{names[i]}_{names[j]}": gram[i, j] / n for i in range(3) for j in range(i, 3)}
    cells |= {f"{names[i]}_y": moment[i] / n for i in range(3)}
    row = spark.createDataFrame([tuple(float(v) for v in cells.values())], ", ".join(f"{c} double" for c in cells))
    return rounded(row, *cells, places=4)


def sql_line(source: str, x: str, y: str, on_intercept: str, on_slope: str) -> str:
    """Intercept and slope of one feature with the given diagonal penalties."""
    return (
        f"SELECT ((xx + {on_slope}) * sy - sx * xy) / ((n + {on_intercept}) * (xx + {on_slope}) - sx * sx) AS b0, "
        f"((n + {on_intercept}) * xy - sx * sy) / ((n + {on_intercept}) * (xx + {on_slope}) - sx * sx) AS b1 "
        f"FROM (SELECT count(*)::DOUBLE AS n, sum({x})::DOUBLE AS sx, sum({y}) AS sy, sum({x} * {x})::DOUBLE AS xx, "
        f"sum({x} * {y}) AS xy FROM {source})"
    )


def _line(fit):
    def run(spark, folder):
        df = table(spark, folder, "lineitem")
        model = fit(df, ["l_quantity"], "l_extendedprice")
        return df.select("l_orderkey", "l_linenumber", F.round(model.predict(), 3).alias("prediction"))

    return run


for _name, _fit, _slope in (("linear", L.fit_linear, "0.001"), ("ridge", L.fit_ridge, "1.0")):
    query(
        f"{_name}_extendedprice", "SUP-2" if _name == "linear" else "SUP-3", "SCO-2",
        sql=f"WITH m AS ({sql_line('lineitem', 'l_quantity', 'l_extendedprice', '0.001', _slope)}) "
        "SELECT l_orderkey, l_linenumber, round(b0 + b1 * l_quantity, 3) AS prediction FROM lineitem, m",
    )(_line(_fit))


@query("linear_wide_coefficients", "SUP-2", "SUP-13")
def linear_wide_coefficients(spark, folder):
    """Five features: coefficients and importance."""
    df = table(spark, folder, "lineitem")
    model = L.fit_linear(df, ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"], "l_extendedprice")
    shares = dict(model.importance())
    rows = [(f, c, shares.get(f, 0.0)) for f, c in zip(model.features, model.coefficients[1:], strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double, importance double")


@query(
    "linear_importance", "SUP-13",
    sql="""
    WITH s AS (SELECT count(*)::DOUBLE AS n, sum(p_size)::DOUBLE AS sx, sum(p_partkey)::DOUBLE AS sz, sum(p_size * p_size)::DOUBLE AS xx,
        sum(p_partkey * p_partkey)::DOUBLE AS zz, sum(p_size * p_partkey)::DOUBLE AS xz, sum(p_retailprice) AS sy,
        sum(p_size * p_retailprice) AS xy, sum(p_partkey * p_retailprice) AS zy FROM part),
    d AS (SELECT (n + 0.001) AS a, sx AS b, sz AS c, xx + 0.001 AS e, xz AS f, zz + 0.001 AS i, sy, xy, zy FROM s),
    g AS (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM d),
    w AS (SELECT (a * (xy * i - f * zy) - sy * (b * i - f * c) + c * (b * zy - xy * c)) / det AS w1,
        (a * (e * zy - xy * f) - b * (b * zy - xy * c) + sy * (b * f - e * c)) / det AS w2 FROM g)
    SELECT 'p_size' AS feature, round(abs(w1) / (abs(w1) + abs(w2)), 5) AS importance FROM w
    UNION ALL SELECT 'p_partkey', round(abs(w2) / (abs(w1) + abs(w2)), 5) FROM w
    """,
)
def linear_importance(spark, folder):
    model = L.fit_linear(table(spark, folder, "part"), ["p_size", "p_partkey"], "p_retailprice")
    return rounded(spark.createDataFrame(model.importance(), "feature string, importance double"), "importance", places=5)


_nb_sql = """
    WITH t AS (SELECT row_number() OVER () AS r, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
        CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END::DOUBLE AS label FROM lineitem),
    c AS (SELECT label, count(*) / (SELECT count(*) FROM t) AS prior, avg(l_quantity) AS m1, var_pop(l_quantity) + 1e-9 AS v1,
        avg(l_extendedprice) AS m2, var_pop(l_extendedprice) + 1e-9 AS v2, avg(l_discount) AS m3, var_pop(l_discount) + 1e-9 AS v3
      FROM t GROUP BY label),
    p AS (SELECT r, l_orderkey, l_linenumber, c.label, ln(prior) - 0.5 * ln(2 * pi() * v1) - 0.5 * ln(2 * pi() * v2) - 0.5 * ln(2 * pi() * v3)
        - ((l_quantity - m1) ** 2 / (2 * v1) + (l_extendedprice - m2) ** 2 / (2 * v2) + (l_discount - m3) ** 2 / (2 * v3)) AS lp
      FROM t, c)
"""


def _flagged(spark, folder):
    return table(spark, folder, "lineitem").withColumn(
        "label", F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    )


NB_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "gaussian_nb_returnflag", "SUP-11", "SCO-1",
    sql=_nb_sql + "SELECT l_orderkey, l_linenumber, arg_max(label, lp) AS prediction, round(max(lp), 6) AS log_density FROM p GROUP BY r, l_orderkey, l_linenumber",
)
def gaussian_nb_returnflag(spark, folder):
    df = _flagged(spark, folder)
    model = L.fit_naive_bayes(df, NB_FEATURES, "label")
    best = F.round(F.array_max(F.array(*model.scores())), 6)
    return df.select("l_orderkey", "l_linenumber", model.predict().alias("prediction"), best.alias("log_density"))


@query(
    "class_statistics_returnflag", "AGG-12",
    sql="""
    SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_discount), 6) AS mean_l_discount,
      round(var_pop(l_quantity), 6) AS var_l_quantity, round(var_pop(l_discount), 6) AS var_l_discount FROM lineitem GROUP BY 1
    """,
)
def class_statistics_returnflag(spark, folder):
    out = L.class_statistics(table(spark, folder, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag")
    return rounded(out, *[c for c in out.columns if c.startswith(("mean_", "var_"))])


def embedded(spark, folder):
    df = table(spark, folder, "embeddings")
    return df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


SQL_DISTANCE = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(
    "nearest_embeddings", "JOI-5", "SRT-4", "JOI-6",
    sql=f"""
    WITH d AS (SELECT a.vec_id AS id, b.vec_id AS neighbor, {SQL_DISTANCE} AS distance
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS rank FROM d)
    SELECT id, neighbor, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5
    """,
)
def nearest_embeddings(spark, folder):
    points = embedded(spark, folder)
    return rounded(N.nearest(points, points, 5, same=True), "distance")


@query(
    "knn_embeddings", "SUP-9", "JOI-5",
    sql=f"""
    WITH d AS (SELECT a.vec_id AS id, b.label, {SQL_DISTANCE} AS distance, b.vec_id AS neighbor
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS rank FROM d),
    v AS (SELECT id, label, count(*) AS votes, max(rank) AS last FROM r WHERE rank <= 5 GROUP BY 1, 2)
    SELECT id, arg_max(label, votes * 100 - last) AS label FROM v GROUP BY id
    """,
)
def knn_embeddings(spark, folder):
    """Every vector classified by its five nearest others."""
    points = embedded(spark, folder)
    found = N.nearest(points, points, 5, same=True)
    return N.classify_by_neighbors(found, points.select(F.col("id").alias("neighbor"), "label"), 5)


_knn_columns = ["p_size", "p_retailprice"]


@query(
    "knn_standardised_part", "SUP-9",
    sql="""
    WITH m AS (SELECT avg(p_size) AS a1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS a2, stddev_pop(p_retailprice) AS s2 FROM part),
    z AS (SELECT p_partkey AS id, (p_size - a1) / s1 AS x, (p_retailprice - a2) / s2 AS y FROM part, m),
    d AS (SELECT a.id, b.id AS neighbor, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM z a JOIN z b ON a.id <> b.id),
    r AS (SELECT id, distance, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS rank FROM d)
    SELECT id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5
    """,
)
def knn_standardised_part(spark, folder):
    df = table(spark, folder, "part")
    scaled = N.as_vector(apply_scale(df, fit_scale(df, _knn_columns)), _knn_columns)
    points = scaled.select(F.col("p_partkey").alias("id"), "vec")
    found = N.nearest(points, points, 5, same=True)
    return rounded(found.select("id", "distance", "rank"), "distance")


@query(
    "logistic_score", "SCO-2", "FUN-4",
    sql="""
    SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-greatest(-500, least(500, -2.5 + 0.1 * l_quantity - 3 * l_discount)))), 8) AS probability,
      CASE WHEN 1 / (1 + exp(-(-2.5 + 0.1 * l_quantity - 3 * l_discount))) >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM lineitem
    """,
)
def logistic_score(spark, folder):
    model = L.LinearModel(["l_quantity", "l_discount"], [-2.5, 0.1, -3.0], "logistic_regression")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(model.probability(), 8).alias("probability"),
        model.predict_class().alias("prediction"),
    )
