"""Metrics, folds and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, table
from tabwright.catalog.learning import sql_line
from tabwright.catalog.profiling import rounded
from tabwright.operators import evaluate as E
from tabwright.operators import fold_products
from tabwright.operators import learners as L

_fit_line = sql_line("lineitem WHERE l_linestatus = 'F'", "l_quantity", "l_extendedprice", "0.001", "0.001")
_scored = f"(SELECT l.*, b0 + b1 * l_quantity AS prediction FROM lineitem l, ({_fit_line}))"


def scored(spark, folder):
    """lineitem with the price predicted by a line fitted on the finished lines."""
    df = table(spark, folder, "lineitem")
    model = L.fit_linear(df.where("l_linestatus = 'F'"), ["l_quantity"], "l_extendedprice")
    return df.withColumn("prediction", model.predict())


@query(
    "regression_metrics", "EVL-1",
    sql=f"""
    SELECT l_linestatus = 'O' AS held_out, count(*) AS n,
      round(1 - sum((l_extendedprice - prediction) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2,
      round(avg(abs(l_extendedprice - prediction)), 3) AS mae, round(avg((l_extendedprice - prediction) ** 2), 0) AS mse,
      round(sqrt(avg((l_extendedprice - prediction) ** 2)), 3) AS rmse FROM {_scored} GROUP BY 1
    """,
)
def regression_metrics(spark, folder):
    df = scored(spark, folder).withColumn("held_out", F.col("l_linestatus") == "O")
    out = E.regression_metrics(df, "l_extendedprice", "prediction", ["held_out"])
    return rounded(rounded(rounded(out, "r2"), "mae", "rmse", places=3), "mse", places=0)


_guess = "CASE WHEN l_quantity > 25 THEN 'A' WHEN l_discount > 0.07 THEN 'X' ELSE 'N' END"


def guessed(spark, folder):
    guess = F.when(F.col("l_quantity") > 25, "A").when(F.col("l_discount") > 0.07, "X").otherwise("N")
    return table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("actual_flag"), guess.alias("guess"), "l_linestatus")


@query(
    "confusion_matrix", "AGG-10",
    sql=f"SELECT l_returnflag AS actual, {_guess} AS predicted, count(*) AS n FROM lineitem GROUP BY ALL",
)
def confusion_matrix(spark, folder):
    return E.confusion(guessed(spark, folder), "actual_flag", "guess")


_per_class = f"""
    WITH m AS (SELECT l_linestatus AS status, l_returnflag AS a, {_guess} AS p FROM lineitem),
    k AS (SELECT DISTINCT status, a AS c FROM m UNION SELECT DISTINCT status, p FROM m),
    s AS (SELECT k.status, k.c, count(*) FILTER (WHERE a = c AND p = c) AS tp, count(*) FILTER (WHERE p = c) AS pn,
        count(*) FILTER (WHERE a = c) AS an FROM k JOIN m ON m.status = k.status GROUP BY 1, 2),
    r AS (SELECT *, CASE WHEN pn > 0 THEN tp / pn ELSE 0 END AS precision, CASE WHEN an > 0 THEN tp / an ELSE 0 END AS recall FROM s),
    f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)
"""


@query(
    "per_class_metrics", "EVL-2", "SET-1",
    sql=_per_class + "SELECT status, c AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, an AS support FROM f",
)
def per_class_metrics(spark, folder):
    matrix = E.confusion(guessed(spark, folder).withColumnRenamed("l_linestatus", "status"), "actual_flag", "guess", ["status"])
    return rounded(E.per_class(matrix, ["status"]).drop("hits"), "precision", "recall", "f1")


@query(
    "classification_metrics", "EVL-2",
    sql=_per_class
    + """, g AS (SELECT status, sum(an) AS n, sum(tp) / sum(an) AS accuracy, avg(precision) AS mp, avg(recall) AS mr,
        sum(f1 * an) / sum(an) AS fw FROM f GROUP BY 1)
    SELECT status, n::BIGINT AS n, round(accuracy, 6) AS accuracy, round(mp, 6) AS precision, round(mr, 6) AS recall,
      round(CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0 END, 6) AS f1_macro, round(fw, 6) AS f1_weighted FROM g""",
)
def classification_metrics(spark, folder):
    df = guessed(spark, folder).withColumnRenamed("l_linestatus", "status")
    out = E.classification_metrics(df, "actual_flag", "guess", ["status"])
    return rounded(out, "accuracy", "precision", "recall", "f1_macro", "f1_weighted")


_fold_sql = " UNION ALL ".join(
    f"SELECT {f} AS fold, round(1 - sum((y - b0 - b1 * x) ** 2) / (var_pop(y) * count(*)), 6) AS score "
    f"FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_orderkey % 5 = {f}), "
    f"({sql_line(f'lineitem WHERE l_orderkey % 5 <> {f}', 'l_quantity', 'l_extendedprice', '0.001', '0.001')})"
    for f in range(5)
)


def _dealt(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", F.col("l_extendedprice").alias("label"))
    return df.withColumn("fold", E.fold_number(F.col("l_orderkey"), 5))


def _fold_scores(spark, folder):
    """All folds from one scan."""
    found = fold_products.fold_scores(_dealt(spark, folder), ["l_quantity"], "label", "fold", [0.001], ridge=False)
    return spark.createDataFrame([(fold, score) for _, fold, score in found], "fold int, score double")


@query("kfold_linear", "EVL-3", sql=_fold_sql)
def kfold_linear(spark, folder):
    return rounded(_fold_scores(spark, folder), "score")


@query("kfold_by_function", "EVL-3", "UDF-2", sql=_fold_sql)
def kfold_by_function(spark, folder):
    """The same folds with a fit that the caller brings."""
    from tabwright.operators.models import cross_validate

    fit = lambda train: L.fit_linear(train, ["l_quantity"], "label").predict()
    return rounded(cross_validate(_dealt(spark, folder), "fold", 5, fit, classification=False), "score")


_ridge_sql = """
    WITH r AS (SELECT l_orderkey % 5 AS f, l_quantity::DOUBLE AS x, l_tax::DOUBLE AS z, l_extendedprice::DOUBLE AS y FROM lineitem),
    p(penalty) AS (VALUES (0.1::DOUBLE), (10.0), (1000.0)),
    s AS (SELECT penalty, g.f AS fold, count(*) + 0.001 AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(x * x) + penalty AS xx,
      sum(x * z) AS xz, sum(z * z) + penalty AS zz, sum(x * y) AS xy, sum(z * y) AS zy
      FROM p, (SELECT DISTINCT f FROM r) g JOIN r ON r.f <> g.f GROUP BY penalty, g.f),
    e AS (SELECT *, n * (xx * zz - xz * xz) - x * (x * zz - xz * z) + z * (x * xz - xx * z) AS d FROM s),
    b AS (SELECT penalty, fold,
      (y * (xx * zz - xz * xz) - x * (xy * zz - xz * zy) + z * (xy * xz - xx * zy)) / d AS b0,
      (n * (xy * zz - xz * zy) - y * (x * zz - xz * z) + z * (x * zy - xy * z)) / d AS b1,
      (n * (xx * zy - xy * xz) - x * (x * zy - xy * z) + y * (x * xz - xx * z)) / d AS b2 FROM e)
    SELECT penalty, fold::INTEGER AS fold, round(1 - sum((r.y - b0 - b1 * r.x - b2 * r.z) ** 2) / (var_pop(r.y) * count(*)), 6) AS score
    FROM b JOIN r ON r.f = b.fold GROUP BY penalty, fold
"""


@query("kfold_ridge_penalties", "EVL-3", "TUN-4", sql=_ridge_sql)
def kfold_ridge_penalties(spark, folder):
    """Three penalties times five folds, one scan in all."""
    df = table(spark, folder, "lineitem").withColumn("fold", E.fold_number(F.col("l_orderkey"), 5))
    found = fold_products.fold_scores(df, ["l_quantity", "l_tax"], "l_extendedprice", "fold", [0.1, 10.0, 1000.0], ridge=True)
    return rounded(spark.createDataFrame(found, "penalty double, fold int, score double"), "score")


@query(
    "cv_summary", "EVL-6",
    sql=f"SELECT round(avg(score), 5) AS cv_mean, round(stddev_pop(score), 5) AS cv_std FROM ({_fold_sql})",
)
def cv_summary(spark, folder):
    return rounded(E.fold_scores(_fold_scores(spark, folder)), "cv_mean", "cv_std", places=5)


@query(
    "stratified_folds_orders", "EVL-4",
    sql="""
    WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS place FROM orders)
    SELECT o_orderkey, o_orderstatus, place % 5 AS fold FROM r
    """,
)
def stratified_folds_orders(spark, folder):
    return E.stratified_folds(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query(
    "residual_rows", "EVL-8",
    sql=f"SELECT l_orderkey, l_linenumber, l_extendedprice AS actual, round(prediction, 3) AS predicted, round(l_extendedprice - prediction, 3) AS residual FROM {_scored}",
)
def residual_rows(spark, folder):
    out = E.residuals(scored(spark, folder), "l_extendedprice", "prediction")
    out = out.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("actual"), F.col("prediction").alias("predicted"), "residual")
    return rounded(out, "predicted", "residual", places=3)


@query(
    "residual_summary", "EVL-8",
    sql=f"""
    WITH r AS (SELECT l_extendedprice - prediction AS e FROM {_scored})
    SELECT round(avg(e), 3) AS mean, round(stddev_pop(e), 3) AS std, round(avg(abs(e)), 3) AS mean_abs,
      CASE WHEN abs(avg(e)) < stddev_pop(e) * 0.5 THEN 'Good' ELSE 'Low' END AS predictive_power FROM r
    """,
)
def residual_summary(spark, folder):
    return rounded(E.residual_summary(scored(spark, folder), "l_extendedprice", "prediction"), "mean", "std", "mean_abs", places=3)


# Each clerk-like group of suppliers stands in for a model: its accuracy in guessing the flag.
_supplier_scores = """
    (SELECT l_suppkey AS model_id, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS accuracy,
      avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS precision, avg(l_discount) * 10 AS recall,
      avg(l_quantity) / 50 AS f1, avg(l_discount) * 8 AS r2, avg(l_extendedprice) / 1000 AS mae,
      stddev_pop(l_extendedprice) / 1000 AS rmse, avg(l_tax) AS duration FROM lineitem GROUP BY 1)
"""


def supplier_models(spark, folder):
    def share(column, value):
        return F.avg(F.when(F.col(column) == value, 1.0).otherwise(0.0))

    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("model_id"))
        .agg(
            share("l_returnflag", "A").alias("accuracy"),
            share("l_linestatus", "F").alias("precision"),
            (F.avg("l_discount") * 10).alias("recall"),
            (F.avg("l_quantity") / 50).alias("f1"),
            (F.avg("l_discount") * 8).alias("r2"),
            (F.avg("l_extendedprice") / 1000).alias("mae"),
            (F.stddev_pop("l_extendedprice") / 1000).alias("rmse"),
            F.avg("l_tax").alias("duration"),
        )
    )


def _compare_sql(score, second, plain):
    return f"""
    WITH s AS (SELECT model_id, {score} AS score, {second} AS second, {plain} AS plain FROM {_supplier_scores}),
    p AS (SELECT *, row_number() OVER (ORDER BY score DESC, model_id) AS place, max(plain) OVER () - min(plain) OVER () AS spread,
        count(*) OVER () AS k FROM s),
    q AS (SELECT *, row_number() OVER (PARTITION BY place > 1 ORDER BY second DESC, model_id) AS n FROM p)
    SELECT model_id, round(score, 6) AS score, CASE WHEN place = 1 THEN 'winner' WHEN k > 2 AND n = 1 THEN 'runner-up' ELSE 'other' END AS role,
      round(spread, 6) AS spread FROM q
    """


_cls_score = "f1 * 0.4 + accuracy * 0.3 + precision * 0.15 + recall * 0.15"
_reg_score = "r2 * 0.5 + (1 - least(1, mae / 100)) * 0.25 + (1 - least(1, rmse / 100)) * 0.25"


@query("compare_classifiers", "EVL-10", sql=_compare_sql(_cls_score, _cls_score, "accuracy"))
def compare_classifiers(spark, folder):
    return rounded(E.compare_models(supplier_models(spark, folder), True), "score", "spread")


@query("compare_regressors", "EVL-10", sql=_compare_sql(_reg_score, "r2", "r2"))
def compare_regressors(spark, folder):
    return rounded(E.compare_models(supplier_models(spark, folder), False), "score", "spread")


@query(
    "radar_models", "EVL-11",
    sql=f"""
    WITH m AS (SELECT * FROM {_supplier_scores}), w AS (SELECT max(mae) AS wm, max(rmse) AS wr FROM m)
    SELECT model_id, 'r2' AS metric, round(greatest(0, least(1, r2)), 6) AS value FROM m
    UNION ALL SELECT model_id, 'mae', round(greatest(0, least(1, 1 - mae / wm)), 6) FROM m, w
    UNION ALL SELECT model_id, 'rmse', round(greatest(0, least(1, 1 - rmse / wr)), 6) FROM m, w
    """,
)
def radar_models(spark, folder):
    return rounded(E.radar(supplier_models(spark, folder), ["r2", "mae", "rmse"]), "value")


def _grade_sql(name, bands):
    arms = " ".join(f"WHEN value < {cut} THEN '{rating}'" for cut, rating in bands if cut is not None)
    return f"WHEN metric = '{name}' THEN CASE {arms} ELSE '{bands[-1][1]}' END"


_graded = ("accuracy", "precision", "recall", "f1", "r2", "mae")


@query(
    "metric_grades", "FUN-6",
    sql=f"""
    WITH m AS (SELECT model_id, metric, value FROM {_supplier_scores} UNPIVOT (value FOR metric IN ({", ".join(_graded)})))
    SELECT model_id, metric, CASE {" ".join(_grade_sql(n, E.GRADES[n]) for n in _graded if n in E.GRADES)} END AS rating,
      CASE WHEN value >= 0.9 THEN 'Excellent' WHEN value >= 0.7 THEN 'Good' WHEN value >= 0.5 THEN 'Fair' ELSE 'Needs Work' END AS band
    FROM m
    """,
)
def metric_grades(spark, folder):
    rows = E.metric_rows(supplier_models(spark, folder), ["model_id"], list(_graded))
    return rows.select("model_id", "metric", E.grade(F.col("metric"), F.col("value")).alias("rating"), E.score_band(F.col("value")).alias("band"))


@query(
    "train_test_gap", "EVL-9",
    sql="""
    WITH m AS (SELECT l_suppkey AS model_id, l_linestatus AS part, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS accuracy,
        avg(l_extendedprice) AS mae FROM lineitem GROUP BY 1, 2),
    u AS (SELECT * FROM m UNPIVOT (value FOR metric IN (accuracy, mae)))
    SELECT a.model_id, a.metric, round(a.value, 6) AS train, round(b.value, 6) AS test,
      round(CASE WHEN a.metric = 'accuracy' THEN (a.value - b.value) * 100 ELSE a.value - b.value END, 4) AS gap,
      a.metric = 'accuracy' AND a.value - b.value > 0.15 AS overfit
    FROM u a JOIN u b ON a.model_id = b.model_id AND a.metric = b.metric AND a.part = 'F' AND b.part = 'O'
    """,
)
def train_test_gap(spark, folder):
    per_part = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("model_id"), F.col("l_linestatus").alias("part"))
        .agg(
            F.avg(F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0)).alias("accuracy"),
            F.avg("l_extendedprice").alias("mae"),
        )
    )
    rows = E.metric_rows(per_part, ["model_id", "part"], ["accuracy", "mae"])
    out = E.train_test_gap(rows.where("part = 'F'").drop("part"), rows.where("part = 'O'").drop("part"), ["model_id"])
    return rounded(rounded(out, "train", "test"), "gap", places=4)


_models = ("A", "N", "R")


@query(
    "importance_side_by_side", "JOI-4",
    sql="""
    WITH i AS (SELECT l_returnflag AS model_id, 'line_' || l_linenumber || '_' || l_linestatus AS feature, sum(l_tax) / 1000 AS importance
      FROM lineitem WHERE l_linenumber < 7 OR l_returnflag <> 'N' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY importance DESC, feature) AS place FROM i),
    c AS (SELECT feature FROM r WHERE place <= 8 GROUP BY 1 ORDER BY min(place), max(importance) DESC, feature LIMIT 10)
    SELECT feature, """
    + ", ".join(f"coalesce(max(CASE WHEN model_id = '{m}' THEN round(importance * 100, 1) END), 0.0) AS {m}" for m in _models)
    + " FROM r WHERE feature IN (SELECT feature FROM c) GROUP BY 1",
)
def importance_side_by_side(spark, folder):
    importances = (
        table(spark, folder, "lineitem")
        .where("l_linenumber < 7 OR l_returnflag <> 'N'")
        .groupBy(
            F.col("l_returnflag").alias("model_id"),
            F.concat_ws("_", F.lit("line"), "l_linenumber", "l_linestatus").alias("feature"),
        )
        .agg((F.sum("l_tax") / 1000).alias("importance"))
    )
    return E.importance_table(importances, _models)
