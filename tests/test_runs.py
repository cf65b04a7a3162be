"""Sources, the result store, complete runs, the stream and the driver entry."""

import pytest
from pyspark.sql import functions as F

from tabwright.operators import models as M
from tabwright.plans.grouping import explore
from tabwright.plans.training import clean, leaderboard_entries, prepare, train
from tabwright.sources import csv, saved_models
from tabwright.sources.tables import ResultStore
from tabwright.streaming.scoring import score_arrivals


def test_csv_drops_rows_of_the_wrong_width(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("name, size ,note\n x ,1, a\ny,2\nz,,c\nw,4,\"d, e\"\nq,1,2,3\n")
    df = csv.read_text(spark, str(path))
    assert df.columns == ["name", "size", "note"]
    rows = [tuple(r) for r in df.orderBy("name").collect()]
    assert rows == [("w", "4", "d, e"), ("x", "1", "a"), ("z", None, "c")]
    assert df.count() == 3
    assert df.select("name").count() == 3
    typed = csv.typed(df)
    assert dict(typed.dtypes) == {"name": "string", "size": "double", "note": "string"}
    assert dict(csv.typed(df, "strict_type").dtypes)["size"] == "string"


def test_pasted_text(spark):
    df = csv.load(spark, text="a,b\n1,x\n2,y\n3\n")
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1.0, "x"), (2.0, "y")]
    with pytest.raises(ValueError):
        csv.load(spark)


def test_written_csv_quotes_commas(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1.5), ('say "hi"', None)], "w string, n double")
    csv.write(df, str(tmp_path / "out"))
    back = csv.load(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in back.collect()} == {("a, b", 1.5), ('say "hi"', None)}


def test_export_is_one_long_table(spark):
    a = spark.createDataFrame([("r2", 0.5)], "metric string, value double")
    b = spark.createDataFrame([(1, "x", 2.0)], "id int, label string, prediction double")
    rows = csv.export_sections({"metrics": (a, ["metric"], ["value"]), "predictions": (b, ["id"], ["label", "prediction"])})
    assert {tuple(r) for r in rows.collect()} == {
        ("metrics", "r2", "value", "0.500000"),
        ("predictions", "1", "label", "x"),
        ("predictions", "1", "prediction", "2.000000"),
    }


def test_store_upserts_and_removes(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    assert store.leaderboard("u").count() == 0
    schema = "user_id string, snapshot_id string, name string, fingerprint string, state string"
    for name in ("first", "second"):
        store.save_snapshot(spark.createDataFrame([("u", name, name, "f", '{"a": {"b": [1, 2]}}'), ("v", name, name, "g", "{}")], schema))
    listed = store.snapshots("u").collect()
    assert [(r.name, "state" in r.asDict()) for r in listed] == [("second", False)]
    assert listed[0].created_at < listed[0].updated_at
    assert store.snapshot("u", "f").first().state == '{"a": {"b": [1, 2]}}'
    store.remove("snapshots", "v", "first")
    assert store.read("snapshots").where("user_id = 'v'").count() == 1
    store.remove_user("u")
    assert store.snapshots("u").count() == 0
    store.save_snapshot(spark.createDataFrame([("u", "third", "third", "f", "{}")], schema))
    assert store.snapshots("u").first().name == "third"
    store.log_activity("u", "u@example.com", "train")
    store.log_scoring("d1", 10)
    store.log_scoring("d1", 5)
    assert store.prediction_counts().first().prediction_count == 2


def test_models_survive_a_round_trip(spark, tmp_path):
    rows = [(i, float(i), float(i % 7), float(2 * i + i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, label double")
    flags = df.withColumn("label", F.when(F.col("a") > 30, 1.0).otherwise(0.0))
    for algorithm, source, classification in (
        ("ridge_regression", df, False), ("baseline", df, False), ("naive_bayes", flags, True), ("random_forest", df, False),
    ):
        fitted = M.fit(algorithm, source, ["a", "b"], classification)
        folder = str(tmp_path / algorithm)
        model_id = saved_models.export(spark, fitted, folder)
        new_id, restored = saved_models.restore(spark, folder)
        assert new_id != model_id
        expected = [r.prediction for r in fitted.predict(source).orderBy("row_id").collect()]
        assert [r.prediction for r in restored.predict(source).orderBy("row_id").collect()] == pytest.approx(expected)
    with pytest.raises(ValueError):
        saved_models.export(spark, M.fit("knn", flags, ["a", "b"], True), str(tmp_path / "knn"))


@pytest.fixture(scope="module")
def loans(spark):
    rows = [
        (i, float(20 + i % 40), float(1000 + 37 * (i % 60)), "abc"[i % 3], None if i % 11 == 0 else float(i % 9), "yes" if i % 40 > 18 else "no")
        for i in range(240)
    ]
    return spark.createDataFrame(rows, "k long, age double, income double, area string, score double, answer string")


def test_cleaning_logs_every_step(loans):
    config = {"exclude": ("area",), "outliers": "clip"}
    out, log = clean(loans, config, keep=("k", "answer"))
    assert out.columns == ["k", "age", "income", "score", "answer"]
    steps = [r.step for r in log.collect()]
    assert steps[:2] == ["exclude", "missing"]
    assert out.where("score IS NULL").count() == 0


def test_supervised_run_with_text_target(loans, spark, tmp_path):
    result = train(loans, "answer", "k", {"scaling": "standard"}, ["decision_tree", "naive_bayes"])
    board = result.leaderboard.collect()
    assert board[0].algorithm == "decision_tree" and board[0].score > 0.9
    assert [r.status for r in board] == ["ok"] * 3
    assert result.prepared.classification and result.prepared.encoder.labels == ["no", "yes"]
    store = ResultStore(spark, str(tmp_path / "store"))
    store.save_leaderboard(leaderboard_entries(result, "u", "loans"))
    stored = store.leaderboard("u").where("algorithm = 'decision_tree'").first()
    assert stored.metrics["accuracy"] == pytest.approx(board[0].score)


def test_supervised_run_needs_rows_and_features(spark):
    three = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 3.0), (3, 3.0, 1.0)], "k long, a double, y double")
    with pytest.raises(ValueError):
        prepare(three, "y", "k")
    only_leaks = spark.createDataFrame([(i, float(i), float(i)) for i in range(9)], "k long, created double, y double")
    with pytest.raises(ValueError):
        prepare(only_leaks, "y", "k")


def test_unsupervised_run(loans):
    found = explore(loans.withColumn("k", F.concat(F.lit("s"), "k")), "k", ["age", "income"], most_k=3)
    assert found.best in found.groupings
    assert found.points().join(found.keys, "id").select("key").distinct().count() == 240
    assert sum(found.explained) == pytest.approx(1.0)
    assert found.isolation.where("anomaly").count() >= 24
    assert found.reading.select("cluster").distinct().count() == found.groupings[found.best].labels.where("cluster >= 0").select("cluster").distinct().count()


def test_a_restored_model_and_encoder_score_raw_rows(spark, loans, tmp_path):
    ready = prepare(loans, "income", "k", {"scaling": "standard"})
    fitted = M.fit("ridge_regression", ready.table, ready.encoder.feature_names, False)
    saved_models.export(spark, fitted, str(tmp_path / "m"), ready.encoder)
    encoder = saved_models.restore_encoder(spark, str(tmp_path / "m"))
    assert encoder == ready.encoder
    raw = loans.where("income is not null")
    before = fitted.predict(ready.encoder.encode(raw, ["k"])).orderBy("k").collect()
    after = saved_models.restore(spark, str(tmp_path / "m"))[1].predict(encoder.encode(raw, ["k"])).orderBy("k").collect()
    assert [r.prediction for r in after] == pytest.approx([r.prediction for r in before])


def test_neighbours_and_folds_take_a_text_key(spark):
    rows = [(i, float(i % 10 + 100 * (i % 2)), float(i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "n long, a double, label double")
    texts = df.withColumn("row_id", F.concat(F.lit("s"), "n")).drop("n")
    part = F.crc32("row_id") % 4 == 0
    board, learners = M.rank_candidates(texts.where(~part), texts.where(part), ["a"], True, ["knn"], folds=3)
    top = board.where("algorithm = 'knn'").first()
    assert top.status == "ok" and top.test_metrics["accuracy"] == 1.0
    assert top.fold_scores == [1.0] * 3 and top.cv_score == 1.0 and top.cv_std == 0.0
    assert set(learners["knn"].predict(texts.where(part)).columns) == {"row_id", "a", "label", "prediction"}


def test_arriving_rows_are_scored_once(spark, tmp_path):
    source, output, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.range(10).select("id", F.col("id").cast("double").alias("a"))
    score = lambda df: df.withColumn("prediction", F.col("a") * 2)
    for start in (0, 100):
        rows.select((F.col("id") + start).alias("id"), "a").coalesce(1).write.mode("append").parquet(source)
        arrivals = spark.readStream.schema(rows.schema).parquet(source)
        score_arrivals(arrivals, score, "d1", output, state).awaitTermination()
    out = spark.read.parquet(output)
    assert out.count() == 20
    assert out.where("prediction = a * 2 AND deploy_id = 'd1'").count() == 20


def test_driver_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert [r.status for r in out.collect()] == ["ok"] * 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_named_task_holds_where_values_repeat(spark):
    """240 rows with 6 distinct prices look like classes; a caller who asks for regression gets residuals."""
    rows = [(i, float(i % 6), 900.1 + 10 * (i % 6)) for i in range(240)]
    df = spark.createDataFrame(rows, "k long, size double, price double")
    found = train(df, "price", "k", algorithms=["ridge_regression"], task="regression")
    assert found.residuals is not None and found.residuals.count() == 1 and not found.prepared.classification
    with pytest.raises(ValueError):
        train(df, "price", "k", algorithms=["ridge_regression"], task="ranking")
    with pytest.raises(ValueError):
        train(df.withColumn("price", F.concat(F.lit("p"), "price")), "price", "k", algorithms=["ridge_regression"], task="regression")
