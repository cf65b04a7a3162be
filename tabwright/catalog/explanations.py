"""Attributions, surrogates and effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.anomalies import standard_points
from tabwright.catalog.base import query, table
from tabwright.catalog.models import REGRESSORS, priced, statuses
from tabwright.catalog.profiling import rounded
from tabwright.functions.sampling import pick
from tabwright.operators import cluster as K
from tabwright.operators import explain as X
from tabwright.operators import models as M
from tabwright.operators.clean import apply_scale, fit_scale
from tabwright.operators.learners import LinearModel

FEATURES = ["l_quantity", "l_discount", "l_tax"]
WEIGHTS = {"l_quantity": 1400.0, "l_discount": -2500.0, "l_tax": 900.0}
PRICE = LinearModel(FEATURES, [250.0, *WEIGHTS.values()])

_base = "250.0 + 1400.0 * avg(l_quantity) - 2500.0 * avg(l_discount) + 900.0 * avg(l_tax)"
_linear = (
    f"WITH m AS (SELECT avg(l_quantity) AS m_l_quantity, avg(l_discount) AS m_l_discount, avg(l_tax) AS m_l_tax, {_base} AS base FROM lineitem), "
    "a AS ("
    + " UNION ALL ".join(
        f"SELECT r, l_orderkey, '{f}' AS feature, {f} AS value, {w} * ({f} - m_{f}) AS attribution, base, "
        f"250.0 + 1400.0 * l_quantity - 2500.0 * l_discount + 900.0 * l_tax AS prediction "
        "FROM (SELECT *, row_number() OVER () AS r FROM lineitem), m"
        for f, w in WEIGHTS.items()
    )
    + ")"
)


def lines(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", *FEATURES)


def attributed(spark, folder):
    return X.linear_attributions(lines(spark, folder), ["l_orderkey"], PRICE)


@query(
    "attributions_linear", "XAI-1", "JOI-8",
    sql=_linear + " SELECT l_orderkey, feature, value, round(attribution, 5) AS attribution, round(base, 4) AS base, round(prediction, 5) AS prediction FROM a",
)
def attributions_linear(spark, folder):
    return rounded(rounded(attributed(spark, folder), "attribution", "prediction", places=5), "base", places=4)


@query("global_importance_linear", "XAI-2", sql=_linear + " SELECT feature, round(avg(abs(attribution)), 4) AS importance FROM a GROUP BY 1")
def global_importance_linear(spark, folder):
    return rounded(X.global_importance(attributed(spark, folder)), "importance", places=4)


@query(
    "direction_summary_linear", "XAI-6",
    sql=_linear
    + """, s AS (SELECT feature, coalesce(avg(attribution) FILTER (WHERE attribution >= 0), 0) AS p, coalesce(avg(attribution) FILTER (WHERE attribution < 0), 0) AS n FROM a GROUP BY 1)
    SELECT feature, round(p, 4) AS positive, round(n, 4) AS negative, CASE WHEN abs(p) > abs(n) THEN 'increase' ELSE 'decrease' END AS direction FROM s""",
)
def direction_summary_linear(spark, folder):
    return rounded(X.direction_summary(attributed(spark, folder)), "positive", "negative", places=4)


_points = (
    _linear
    + ", g AS (SELECT feature, min(value) AS lo, max(value) - min(value) AS w FROM a GROUP BY 1), "
    "p AS (SELECT a.*, CASE WHEN w > 0 THEN (value - lo) / w ELSE 0.5 END AS normalized FROM a JOIN g USING (feature))"
)


@query("normalized_points_linear", "XAI-3", sql=_points + " SELECT l_orderkey, feature, round(attribution, 4) AS attribution, round(normalized, 6) AS normalized FROM p")
def normalized_points_linear(spark, folder):
    df = lines(spark, folder)
    out = X.normalized_points(attributed(spark, folder), df, FEATURES)
    out = out.select("l_orderkey", "feature", "attribution", "normalized")
    return rounded(rounded(out, "attribution", places=4), "normalized")


@query("dependence_linear", "XAI-4", sql=_linear + " SELECT value, round(attribution, 4) AS attribution FROM a WHERE feature = 'l_discount'")
def dependence_linear(spark, folder):
    return rounded(X.dependence(attributed(spark, folder), "l_discount"), "attribution", places=4)


@query(
    "effect_ranges_linear", "XAI-7",
    sql=_points
    + """, e AS (SELECT feature, coalesce(avg(attribution) FILTER (WHERE normalized > 0.6), 0) AS high,
        coalesce(avg(attribution) FILTER (WHERE normalized < 0.4), 0) AS low, avg(abs(attribution)) AS importance FROM p GROUP BY 1)
    SELECT feature, round(high, 4) AS high, round(low, 4) AS low, round(importance, 4) AS importance,
      CASE WHEN high > low THEN 'higher' ELSE 'lower' END AS advice FROM e ORDER BY e.importance DESC, feature LIMIT 5""",
)
def effect_ranges_linear(spark, folder):
    df = lines(spark, folder)
    points = X.normalized_points(attributed(spark, folder), df, FEATURES)
    return rounded(X.effect_ranges(points), "high", "low", "importance", places=4)


PART_MODEL = LinearModel(["p_size", "p_retailprice", "p_partkey"], [10.0, -3.0, 2.0, 0.5])
_part = "WITH m AS (SELECT avg(p_size) AS m1, avg(p_retailprice) AS m2, avg(p_partkey) AS m3 FROM part), a AS (" + " UNION ALL ".join(
    f"SELECT p_partkey AS key, '{f}' AS feature, {w} * ({f} - {m}) AS attribution, 10.0 - 3.0 * m1 + 2.0 * m2 + 0.5 * m3 AS base FROM part, m"
    for f, w, m in (("p_size", "-3.0", "m1"), ("p_retailprice", "2.0", "m2"), ("p_partkey", "0.5", "m3"))
) + ")"


def part_attributions(spark, folder):
    df = table(spark, folder, "part").withColumn("key", F.col("p_partkey"))
    return X.linear_attributions(df, ["key"], PART_MODEL)


@query(
    "waterfall_part", "XAI-8", "WIN-3",
    sql=_part
    + """, w AS (SELECT *, row_number() OVER o AS place, base + sum(attribution) OVER (o ROWS UNBOUNDED PRECEDING) AS ends FROM a
      WINDOW o AS (PARTITION BY key ORDER BY abs(attribution) DESC, feature))
    SELECT key, feature, place, round(attribution, 5) AS attribution, round(least(ends, ends - attribution), 4) AS "offset", round(abs(attribution), 5) AS width FROM w""",
)
def waterfall_part(spark, folder):
    out = X.waterfall(part_attributions(spark, folder), ["key"])
    return rounded(rounded(out, "attribution", "width", places=5), "offset", places=4)


@query(
    "force_part", "XAI-8",
    sql=_part
    + """ SELECT key, CASE WHEN attribution >= 0 THEN 'positive' ELSE 'negative' END AS side, round(sum(abs(attribution)), 4) AS total,
      string_agg(feature, '|' ORDER BY abs(attribution) DESC, feature) AS features FROM a GROUP BY 1, 2""",
)
def force_part(spark, folder):
    return rounded(X.force(part_attributions(spark, folder), ["key"]), "total", places=4)


@query(
    "value_and_prediction", "XAI-11", "UDF-1",
    sql=" UNION ALL ".join(
        f"SELECT '{f}' AS feature, {f}::DOUBLE AS value, round(10.0 - 3.0 * p_size + 2.0 * p_retailprice + 0.5 * p_partkey, 5) AS prediction FROM part"
        for f in PART_MODEL.features
    ),
)
def value_and_prediction(spark, folder):
    score = lambda df: df.withColumn("prediction", PART_MODEL.predict())
    return rounded(X.value_and_prediction(table(spark, folder, "part"), PART_MODEL.features, score), "prediction", places=5)


def forest(spark, folder):
    df = priced(spark, folder)
    return df, M.fit("random_forest", df, REGRESSORS, classification=False).predict


@query("attributions_forest", "XAI-1", "XAI-5", "JOI-8")
def attributions_forest(spark, folder):
    df, score = forest(spark, folder)
    return X.sampled_attributions(df, ["row_id"], REGRESSORS, score, "global")


@query("importance_forest", "XAI-2", "XAI-5")
def importance_forest(spark, folder):
    df, score = forest(spark, folder)
    return X.global_importance(X.sampled_attributions(df, ["row_id"], REGRESSORS, score, "global"))


@query("points_forest", "XAI-3", "XAI-5")
def points_forest(spark, folder):
    df, score = forest(spark, folder)
    return X.normalized_points(X.sampled_attributions(df, ["row_id"], REGRESSORS, score, "points"), df, REGRESSORS)


@query("dependence_forest", "XAI-4", "XAI-5")
def dependence_forest(spark, folder):
    df, score = forest(spark, folder)
    return X.dependence(X.sampled_attributions(df, ["row_id"], REGRESSORS, score, "dependence"), "p_retailprice")


@query("local_surrogate_forest", "XAI-9")
def local_surrogate_forest(spark, folder):
    df, score = forest(spark, folder)
    return X.local_surrogate(pick(df, ["row_id"], 10), ["row_id"], df, REGRESSORS, score)


@query("class_shares_status", "XAI-10")
def class_shares_status(spark, folder):
    df, features = statuses(spark, folder)
    fitted = M.fit("decision_tree", df, features, classification=True)
    return X.class_shares(pick(df, ["row_id"], 10), ["row_id"], df, features, fitted.predict)


@query("cluster_attributions", "XAI-12")
def cluster_attributions(spark, folder):
    columns = ["p_size", "p_retailprice"]
    df = table(spark, folder, "part")
    centers = K.kmeans(standard_points(df, "p_partkey", columns), 4).centers
    scaled = apply_scale(df, fit_scale(df, columns))
    score = X.nearest_center_score(columns, centers)
    return X.global_importance(X.sampled_attributions(scaled, ["p_partkey"], columns, score, "global"))
