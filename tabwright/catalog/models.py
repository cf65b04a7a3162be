"""Spark's learners, ranking, tuning and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, spread_table, table
from tabwright.catalog.evaluation import _fit_line, scored
from tabwright.catalog.profiling import rounded
from tabwright.functions.sampling import train_test
from tabwright.operators import evaluate as E
from tabwright.operators import models as M
from tabwright.operators import score as S
from tabwright.operators import text as T
from tabwright.operators.learners import LinearModel, fit_linear
from tabwright.session import cut_lineage

REGRESSORS = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


def priced(spark, folder):
    """lineitem with its part: inputs and the price to predict."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    return (
        spread_table(spark, folder, "lineitem")
        .join(parts, "l_partkey")
        .select(
            F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("row_id"),
            *[F.col(c).cast("double").alias(c) for c in REGRESSORS],
            F.col("l_extendedprice").alias("label"),
        )
    )


def judged(spark, folder):
    """Labelled documents as weights of their most frequent terms and their length."""
    documents = spread_table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    weights = cut_lineage(T.tfidf(documents, "doc_id", "text"))
    names = [r.term for r in weights.select("term").distinct().orderBy("term").collect()]
    matrix = T.text_matrix(weights, "doc_id", names)
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    features = [f"tfidf_{i}" for i in range(len(names))]
    out = documents.select("doc_id", F.col("n_chars").cast("double").alias("n_chars")).join(labels, "doc_id")
    out = out.join(matrix, "doc_id", "left").fillna(0.0, features)
    return out.withColumnRenamed("doc_id", "row_id"), ["n_chars", *features]


def statuses(spark, folder):
    """Orders with their status as a three-class label."""
    orders = spread_table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("row_id"),
        "o_totalprice",
        F.month("o_orderdate").cast("double").alias("month"),
        F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0).alias("label"),
    ), ["o_totalprice", "month"]


def _regressor(algorithm, *covers):
    @query(f"{algorithm}_price", *covers)
    def run(spark, folder):
        train, test = train_test(priced(spark, folder), ["row_id"])
        fitted = M.fit(algorithm, train, REGRESSORS, classification=False)
        return E.regression_metrics(fitted.predict(test), "label", "prediction")

    return run


for _algorithm, _covers in {
    "decision_tree": ("SUP-6", "SCO-1"),
    "random_forest": ("SUP-7", "SCO-1"),
    "gradient_boosting": ("SUP-8", "SCO-1"),
}.items():
    _regressor(_algorithm, *_covers)


def _classifier(algorithm, source, name, *covers):
    @query(f"{algorithm}_{name}", *covers)
    def run(spark, folder):
        df, features = source(spark, folder)
        train, test = train_test(df, ["row_id"])
        fitted = M.fit(algorithm, train, features, classification=True)
        return E.classification_metrics(fitted.predict(test), "label", "prediction")

    return run


_classifier("logistic_regression", judged, "quality", "SUP-5", "FEA-5")
_classifier("decision_tree", judged, "quality", "SUP-6")
_classifier("random_forest", judged, "quality", "SUP-7")
_classifier("gradient_boosting", judged, "quality", "SUP-8")
_classifier("svm", judged, "quality", "SUP-10")
_classifier("logistic_regression", statuses, "status", "SUP-5")
_classifier("svm", statuses, "status", "SUP-10")


@query("standardised_linear_price", "SUP-4")
def standardised_linear_price(spark, folder):
    """Linear regression on standardised inputs: one coefficient per feature."""
    from tabwright.operators.clean import apply_scale, fit_scale

    df = priced(spark, folder)
    model = fit_linear(apply_scale(df, fit_scale(df, REGRESSORS)), REGRESSORS, "label", 0.0)
    rows = [("intercept", model.coefficients[0]), *zip(model.features, model.coefficients[1:], strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double")


@query("forest_importance_price", "SUP-13")
def forest_importance_price(spark, folder):
    fitted = M.fit("random_forest", priced(spark, folder), REGRESSORS, classification=False)
    return spark.createDataFrame(fitted.importance, "feature string, importance double")


@query("ranked_regressors_price", "SUP-12", "EVL-7")
def ranked_regressors_price(spark, folder):
    train, test = train_test(priced(spark, folder), ["row_id"])
    board, _ = M.rank_candidates(train, test, REGRESSORS, classification=False)
    return board.select("algorithm", "status", "score", F.col("train_metrics")["r2"].alias("train_r2"))


@query("ranked_classifiers_quality", "SUP-12", "EVL-7")
def ranked_classifiers_quality(spark, folder):
    df, features = judged(spark, folder)
    train, test = train_test(df, ["row_id"])
    board, _ = M.rank_candidates(train, test, features, classification=True)
    return board.select("algorithm", "status", "score", F.col("train_metrics")["accuracy"].alias("train_accuracy"))


@query("cross_validated_tree", "EVL-3", "EVL-7")
def cross_validated_tree(spark, folder):
    train, test = train_test(priced(spark, folder), ["row_id"])
    board, _ = M.rank_candidates(train, test, REGRESSORS, False, ["decision_tree"], folds=5)
    return board.select("algorithm", "score", "cv_score")


_ranges = """
    SELECT 'l_linenumber' AS name, min(l_linenumber)::DOUBLE AS low, max(l_linenumber)::DOUBLE AS high, 1.0::DOUBLE AS step FROM lineitem
    UNION ALL SELECT 'l_quantity', min(l_quantity), max(l_quantity), 1.0 FROM lineitem
    UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), 0.005 FROM lineitem
"""


@query(
    "parameter_grid", "TUN-2", "JOI-9", "TUN-1",
    sql=f"""
    WITH v AS (SELECT name, list_transform(range(0, CAST(floor((high - low) / step + 1e-9) AS BIGINT) + 1), lambda i : round(low + i * step, 3)) AS g
      FROM ({_ranges})),
    t AS (SELECT name, list_filter(g, lambda x, i : len(g) <= 8 OR i = len(g) OR (i - 1) % greatest(1, len(g) // 7) = 0) AS g FROM v),
    u AS (SELECT name, unnest(g) AS value FROM t)
    SELECT a.value AS l_linenumber, b.value AS l_quantity, c.value AS l_tax FROM u a, u b, u c
    WHERE a.name = 'l_linenumber' AND b.name = 'l_quantity' AND c.name = 'l_tax'
    """,
)
def parameter_grid(spark, folder):
    df = table(spark, folder, "lineitem")
    steps = {"l_linenumber": 1.0, "l_quantity": 1.0, "l_tax": 0.005}
    rows = [
        F.struct(F.lit(c).alias("name"), F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high"), F.lit(s).alias("step"))
        for i, (c, s) in enumerate(steps.items())
    ]
    ends = [f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(steps) for f, n in ((F.min, "a"), (F.max, "b"))]
    return M.grid_table(df.agg(*ends).select(F.inline(F.array(*rows))))


@query("tuned_tree_price", "TUN-3", "TUN-4", "TUN-5")
def tuned_tree_price(spark, folder):
    """Random search over tree settings, then the refit with the best ones."""
    train, test = train_test(priced(spark, folder), ["row_id"])
    first = M.fit("decision_tree", train, REGRESSORS, False, {"maxDepth": 2})
    original = E.regression_metrics(first.predict(test), "label", "prediction").first().r2
    draws = M.random_parameters(M.TUNABLE["decision_tree"], 20)
    tuning = M.tune("decision_tree", train, test, REGRESSORS, False, draws, original)
    better = M.apply_best("decision_tree", tuning, train, REGRESSORS, False) or first
    final = E.regression_metrics(better.predict(test), "label", "prediction")
    return final.withColumns({"original_r2": F.lit(original), "best_trial_r2": F.lit(tuning.best_score)})


@query("grid_search_ridge", "TUN-2", "TUN-4")
def grid_search_ridge(spark, folder):
    train, test = train_test(priced(spark, folder), ["row_id"])
    grid = list(M.parameter_grid({"lambda": M.TUNABLE["ridge_regression"]["lambda"]}))
    return M.tune("ridge_regression", train, test, REGRESSORS, False, grid).trials


@query("class_probabilities_status", "SCO-3", "SCO-4")
def class_probabilities_status(spark, folder):
    df, features = statuses(spark, folder)
    train, test = train_test(df, ["row_id"])
    fitted = M.fit("logistic_regression", train, features, classification=True)
    out = S.class_confidence(S.class_probabilities(fitted.predict(test)))
    return S.decode(out, ["F", "O", "P"]).select("row_id", "prediction", "confidence", "confidence_level")


@query(
    "class_confidence", "SCO-4",
    sql="""
    WITH p AS (SELECT l_orderkey, l_linenumber, 1 / (1 + exp(-(0.12 * l_quantity - 3))) AS p FROM lineitem),
    c AS (SELECT *, greatest(p, 1 - p) * 100 AS c FROM p)
    SELECT l_orderkey, l_linenumber, round(c, 6) AS confidence, CASE WHEN c < 70 THEN 'Low' WHEN c < 85 THEN 'Medium' ELSE 'High' END AS confidence_level FROM c
    """,
)
def class_confidence(spark, folder):
    model = LinearModel(["l_quantity"], [-3.0, 0.12], "logistic_regression")
    df = table(spark, folder, "lineitem").withColumn("p", model.probability())
    out = S.class_confidence(df.withColumn("probabilities", F.array(1 - F.col("p"), F.col("p"))))
    return rounded(out.select("l_orderkey", "l_linenumber", "confidence", "confidence_level"), "confidence")


_inputs = ["l_quantity", "l_discount", "l_tax", "zero"]


@query(
    "input_confidence", "SCO-4",
    sql="""
    WITH c AS (SELECT l_orderkey, l_linenumber, ((l_quantity <> 0)::INT + (l_discount <> 0)::INT + (l_tax <> 0)::INT) / 4 * 100 AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, c AS confidence, CASE WHEN c < 50 THEN 'Low' WHEN c < 75 THEN 'Medium' ELSE 'High' END AS confidence_level FROM c
    """,
)
def input_confidence(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("zero", F.lit(0.0))
    return S.input_confidence(df, _inputs).select("l_orderkey", "l_linenumber", "confidence", "confidence_level")


@query(
    "worst_text_confidence", "SCO-4",
    sql="""
    WITH c AS (SELECT CASE WHEN d < 0.05 THEN 30.0 WHEN d < 0.15 THEN 65.0 ELSE 88.0 END AS c FROM
      (SELECT ((l_quantity > 0)::INT + (l_discount > 0)::INT + (l_tax > 0)::INT) / 4 AS d FROM lineitem))
    SELECT min(c)::DOUBLE AS confidence, CASE min(c) WHEN 30.0 THEN 'Low' WHEN 65.0 THEN 'Medium' ELSE 'High' END AS confidence_level FROM c
    """,
)
def worst_text_confidence(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("zero", F.lit(0.0))
    return S.worst_level(S.input_confidence(df, _inputs, text_features=_inputs))


_line = f"(SELECT l.*, b0 + b1 * l_quantity - 5000 AS prediction FROM lineitem l, ({_fit_line}))"


@query(
    "clamped_predictions", "SCO-5",
    sql=f"""
    SELECT l_orderkey, l_linenumber, round(greatest(0.0, prediction), 3) AS prediction, l_quantity < 3 AND l_linenumber = 1 AS input_empty FROM {_line}
    """,
)
def clamped_predictions(spark, folder):
    df = scored(spark, folder).withColumn("prediction", F.col("prediction") - 5000)
    low = df.agg(F.min("l_extendedprice")).first()[0]
    blank = (F.col("l_quantity") < 3) & (F.col("l_linenumber") == 1)
    df = df.withColumns({"quantity": F.when(~blank, F.col("l_quantity")), "note": F.when(~blank, F.col("l_returnflag")).otherwise("")})
    out = S.flag_empty_input(S.clamp_non_negative(df, low), ["quantity", "note"])
    return rounded(out.select("l_orderkey", "l_linenumber", "prediction", "input_empty"), "prediction", places=3)


@query(
    "scenario_comparison", "SCO-6",
    sql="""
    WITH m AS (SELECT p_partkey, p_size, p_retailprice, 100 + 2.0 * p_retailprice - 3.0 * p_size AS b,
        100 + 2.0 * p_retailprice * 1.1 - 3.0 * CASE WHEN p_size > 40 THEN 40 ELSE p_size END AS c FROM part)
    SELECT p_partkey, round(b, 6) AS baseline, round(c, 6) AS modified, round(c - b, 4) AS difference, round((c - b) / abs(b) * 100, 4) AS pct_change,
      CASE WHEN p_size > 40 THEN 'p_retailprice|p_size' ELSE 'p_retailprice' END AS changed FROM m
    """,
)
def scenario_comparison(spark, folder):
    model = LinearModel(["p_retailprice", "p_size"], [100.0, 2.0, -3.0])
    df = table(spark, folder, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    changes = {"p_retailprice": F.col("p_retailprice") * 1.1, "p_size": F.least(F.col("p_size"), F.lit(40.0))}
    out = S.compare_scenarios(df, ["p_partkey"], changes, lambda d: d.withColumn("prediction", model.predict()))
    return rounded(rounded(out, "baseline", "modified"), "difference", "pct_change", places=4)


@query(
    "rows_worth_explaining", "SRT-5",
    sql="""
    WITH h AS (SELECT p_partkey AS key, 100 + 2.0 * p_retailprice - 3.0 * p_size AS prediction FROM part),
    m AS (SELECT list_sort(list(prediction))[count(*) // 2 + 1] AS middle FROM h)
    (SELECT 'highest' AS pick, key, round(prediction, 6) AS prediction FROM h ORDER BY h.prediction DESC, key LIMIT 1)
    UNION ALL (SELECT 'lowest', key, round(prediction, 6) FROM h ORDER BY h.prediction, key LIMIT 1)
    UNION ALL (SELECT 'median', key, round(prediction, 6) FROM h, m WHERE prediction = middle ORDER BY key LIMIT 1)
    """,
)
def rows_worth_explaining(spark, folder):
    model = LinearModel(["p_retailprice", "p_size"], [100.0, 2.0, -3.0])
    df = table(spark, folder, "part").withColumn("prediction", model.predict())
    return rounded(S.row_suggestions(df, "p_partkey"), "prediction")
