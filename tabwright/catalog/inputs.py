"""Reading, writing and the complete runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabwright.catalog.base import query, table
from tabwright.catalog.evaluation import _scored, scored
from tabwright.catalog.models import REGRESSORS, priced
from tabwright.catalog.profiling import rounded
from tabwright.functions.sampling import train_test
from tabwright.operators import explain as X
from tabwright.operators import models as M
from tabwright.operators import score as S
from tabwright.operators.evaluate import metric_rows, regression_metrics
from tabwright.operators.learners import LinearModel
from tabwright.plans.grouping import explore
from tabwright.plans.training import leaderboard_entries, prepare, train
from tabwright.session import ensure_checkpoint_dir
from tabwright.sources import csv, saved_models
from tabwright.sources.tables import ResultStore


def scratch(spark) -> str:
    """A new folder where every executor can write."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


@query(
    "csv_round_trip_part", "SRC-1", "SRC-5", "SRC-3", "FUN-1",
    sql="""
    SELECT p_partkey::DOUBLE AS p_partkey, p_name || ', ' || p_type AS label, CASE WHEN p_size > 5 THEN p_size::DOUBLE END AS p_size, p_retailprice FROM part
    """,
)
def csv_round_trip_part(spark, folder):
    df = table(spark, folder, "part").select(
        "p_partkey", F.concat_ws(", ", "p_name", "p_type").alias("label"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("p_size"), "p_retailprice"
    )
    path = scratch(spark)
    csv.write(df, path)
    return csv.load(spark, path)


@query(
    "csv_inferred_types", "SRC-2",
    sql="SELECT o_orderkey::BIGINT AS o_orderkey, o_orderstatus, o_totalprice FROM orders",
)
def csv_inferred_types(spark, folder):
    path = scratch(spark)
    csv.write(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return csv.read_inferred(spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("preview_part", "SRC-4", sql="SELECT * FROM part ORDER BY p_partkey LIMIT 5")
def preview_part(spark, folder):
    """The feature itself: names and five rows, here in the order of the key."""
    return csv.preview(table(spark, folder, "part").orderBy("p_partkey"))[1]


@query(
    "scored_csv", "SRC-6", "SCO-1",
    sql=f"SELECT l_orderkey::DOUBLE AS l_orderkey, l_quantity, round(prediction, 3) AS predicted_l_extendedprice FROM {_scored}",
)
def scored_csv(spark, folder):
    path = scratch(spark)
    csv.write_scored(scored(spark, folder).select("l_orderkey", "l_quantity", "prediction"), "l_extendedprice", path)
    return rounded(csv.load(spark, path), "predicted_l_extendedprice", places=3)


@query("results_export", "SRC-7", "SET-3")
def results_export(spark, folder):
    """Metrics, leaderboard, attributions and predictions in one long table, written and read back."""
    train_rows, test_rows = train_test(priced(spark, folder), ["row_id"])
    board, fitted = M.rank_candidates(train_rows, test_rows, REGRESSORS, False, ["ridge_regression", "linear_regression"])
    best = fitted["ridge_regression"]
    predicted = best.predict(test_rows)
    shares = X.global_importance(X.linear_attributions(test_rows, ["row_id"], best.model))
    sections = {
        "metrics": (metric_rows(regression_metrics(predicted, "label", "prediction"), [], ["r2", "mae", "rmse"]), ["metric"], ["value"]),
        "leaderboard": (board, ["algorithm"], ["score"]),
        "attributions": (shares, ["feature"], ["importance"]),
        "predictions": (predicted, ["row_id"], ["label", "prediction"]),
    }
    path = scratch(spark)
    csv.write(csv.export_sections(sections), path)
    return spark.read.csv(path, header=True)


@query("saved_pipeline_scores", "SRC-8", "SCO-1")
def saved_pipeline_scores(spark, folder):
    """A tree written, read back and used to score every line."""
    df = priced(spark, folder)
    path = scratch(spark)
    saved_models.export(spark, M.fit("decision_tree", df, REGRESSORS, False, {"maxDepth": 5}), path)
    _, restored = saved_models.restore(spark, path)
    return restored.predict(df).select("row_id", "prediction")


@query(
    "saved_line_scores", "SRC-8", "SCO-2", "FUN-10",
    sql="SELECT p_partkey, round(100 + 2.0 * p_retailprice - 3.0 * p_size, 6) AS prediction FROM part",
)
def saved_line_scores(spark, folder):
    model = LinearModel(["p_retailprice", "p_size"], [100.0, 2.0, -3.0])
    path = scratch(spark)
    saved_models.export(spark, M.Fitted(model.algorithm, model.features, lambda d: d, [], model), path)
    _, restored = saved_models.restore(spark, path)
    return rounded(restored.predict(table(spark, folder, "part")).select("p_partkey", "prediction"), "prediction")


@query(
    "stored_activity", "SRC-9", "REG-1", "REG-2", "REG-10",
    sql="""
    SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS action, count(*) AS n FROM events
    WHERE user_id <> (SELECT min(user_id) FROM events) GROUP BY 1, 2
    """,
)
def stored_activity(spark, folder):
    """Events appended to the store in two goes, one user removed, the rest counted."""
    store = ResultStore(spark, scratch(spark))
    events = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("action"), F.col("props").alias("details"), F.col("ts").alias("created_at")
    )
    store.append("activity", events.where("action = 'click'"))
    store.append("activity", events.where("action <> 'click'"))
    store.remove_user(str(table(spark, folder, "events").agg(F.min("user_id")).first()[0]))
    return store.read("activity").groupBy("user_id", "action").agg(F.count("*").alias("n"))


@query("stored_leaderboard", "REG-1", "REG-8", "SRC-9")
def stored_leaderboard(spark, folder):
    """Train on customers, store the leaderboard and the run, read a user's entries back."""
    store = ResultStore(spark, scratch(spark))
    df = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    result = train(df, "c_acctbal", "c_custkey", algorithms=["ridge_regression", "decision_tree"])
    store.save_leaderboard(leaderboard_entries(result, "u1", "customer"))
    run = spark.createDataFrame(
        [("regression", result.best.algorithm, df.count(), "c_acctbal")],
        "problem_type string, best_algorithm string, num_samples long, target_column string",
    )
    store.append("history", run.withColumn("created_at", F.current_timestamp()))
    return store.leaderboard("u1").select("algorithm", "dataset_name", "num_samples", F.map_keys("metrics").alias("metric_names"))


@query("prepared_part", "CLN-14")
def prepared_part(spark, folder):
    """The preprocessing steps in order: the log of what each one did."""
    df = table(spark, folder, "part").withColumn("p_size", F.when(F.col("p_size") > 5, F.col("p_size")))
    spiky = F.when(F.col("p_brand") == "Brand#1", F.col("p_retailprice") * 50).otherwise(F.col("p_retailprice"))
    df = df.withColumn("p_cost", spiky)
    config = {"exclude": ("p_name",), "outliers": "clip", "scaling": "standard"}
    return prepare(df, "p_retailprice", "p_partkey", config).log


@query("trained_on_orders", "SUP-12", "EVL-7", "EVL-8", "CLN-14")
def trained_on_orders(spark, folder):
    """The complete supervised run with a text target."""
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    result = train(df, "o_orderstatus", "o_orderkey", {"scaling": "standard"}, ["logistic_regression", "random_forest", "naive_bayes"])
    return result.leaderboard.select("algorithm", "status", "score")


@query("residuals_of_best", "EVL-8", "EVL-7")
def residuals_of_best(spark, folder):
    """The price is a quantity, however often its values repeat in a large table."""
    df = table(spark, folder, "part")
    algorithms = ["ridge_regression", "random_forest"]
    return train(df, "p_retailprice", "p_partkey", algorithms=algorithms, task="regression").residuals


@query("decoded_predictions", "SCO-1", "FEA-2", "FEA-6")
def decoded_predictions(spark, folder):
    """Status predicted for every order, as text."""
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    result = train(df, "o_orderstatus", "o_orderkey", algorithms=["decision_tree"])
    encoder = result.prepared.encoder
    scored_rows = result.learners["decision_tree"].predict(encoder.encode(df, ["o_orderkey"]))
    return S.decode(scored_rows, encoder.labels).select("o_orderkey", "prediction")


@query("explored_part", "UNS-12")
def explored_part(spark, folder):
    """The complete unsupervised run: its algorithm leaderboard."""
    found = explore(table(spark, folder, "part"), "p_partkey", ["p_size", "p_retailprice"])
    return found.leaderboard.select("algorithm", "status", "clusters", "noise", "silhouette")


@query("explored_points", "UNS-12", "ANO-4")
def explored_points(spark, folder):
    """Projected suppliers with cluster and anomaly mark."""
    found = explore(table(spark, folder, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"])
    return found.points()
