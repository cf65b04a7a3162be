"""Gradient steps and mixture rounds beyond what SQL checks: convergence, classes, odd rows, tuning, saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import descent, fold_products, learners, mixture, models
from tabwright.operators.evaluate import regression_metrics
from tabwright.sources import saved_models

DRAW = np.random.default_rng(21)


@pytest.fixture(scope="module")
def table(spark):
    x = DRAW.normal(size=(300, 2))
    kind = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.2, 1.0, 0.0) + (x[:, 1] > 1)
    rows = [(i, float(a), float(b), float(k)) for i, ((a, b), k) in enumerate(zip(x, kind, strict=True))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, label double").repartition(3)


def two(table):
    return table.withColumn("label", F.least("label", F.lit(1.0)))


def accuracy(df, prediction):
    return df.agg(F.avg((prediction == F.col("label")).cast("double"))).first()[0]


@pytest.mark.parametrize("classes", [2, 3])
def test_steps_learn(table, classes):
    df = table if classes == 3 else two(table)
    for model in (descent.fit_logistic(df, ["a", "b"], "label", 0.5, 60, 0.0), descent.fit_svm(df, ["a", "b"], "label", 1.0, 0.2, 60)):
        assert len(model.weights) == (classes if classes > 2 else 1)
        # One class against the rest cannot cut out a class that lies between two others.
        wanted = 0.8 if classes == 3 and model.algorithm == "svm" else 0.9
        assert model.losses[-1] < model.losses[0] and accuracy(df, model.predict()) > wanted
        assert abs(sum(share for _, share in model.importance()) - 1) < 1e-9


def test_learning_rate_and_epochs_have_an_effect(table):
    df = two(table)
    for algorithm in ("logistic_regression", "svm"):
        fitted = [
            models.fit(algorithm, df, ["a", "b"], True, {"learningRate": rate, "epochs": steps}).model.weights
            for rate, steps in ((0.1, 5), (0.2, 5), (0.1, 10))
        ]
        assert len({tuple(w[0]) for w in fitted}) == 3


def test_saved_steps_score_alike(spark, table, tmp_path):
    fitted = models.fit("svm", table, ["a", "b"], True, {"learningRate": 0.1, "epochs": 5})
    saved_models.export(spark, fitted, str(tmp_path))
    _, again = saved_models.restore(spark, str(tmp_path))
    one, two_ = ({r.row_id: r.prediction for r in m.predict(table).collect()} for m in (fitted, again))
    assert one == two_


def test_odd_training_tables(spark, table):
    for fit in (descent.fit_logistic, descent.fit_svm):
        none = fit(table.where("row_id < 0"), ["a"], "label", epochs=3)
        same = fit(table.withColumn("label", F.lit(4.0)), ["a"], "label", epochs=3)
        assert {r[0] for r in table.select(none.predict()).collect()} == {0.0}
        assert {r[0] for r in table.select(same.predict()).collect()} == {4.0}
        blank = table.unionByName(spark.createDataFrame([(-1, None, 1.0, 1.0), (-2, 1.0, 1.0, None)], table.schema))
        constant = blank.withColumn("c", F.lit(7.0))
        assert np.isfinite(fit(constant, ["a", "b", "c"], "label", epochs=3).weights).all()


def test_mixture_finds_two_clouds(spark):
    x = np.concatenate([DRAW.normal((0, 0), (0.2, 1.0), (150, 2)), DRAW.normal((6, 6), (1.0, 0.3), (50, 2))])
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>")
    found = mixture.diagonal_mixture(points, [[1.0, 1.0], [4.0, 5.0]], 15)
    steps = found.log_likelihoods
    assert len(steps) == 15 and all(b >= a - 1e-6 for a, b in zip(steps, steps[1:], strict=False))
    labels = {r.id: r.cluster for r in found.labels.collect()}
    assert {labels[i] for i in range(150)} == {0} and {labels[i] for i in range(150, 200)} == {1}
    assert np.allclose(found.weights, [0.75, 0.25]) and np.allclose(found.centers[1], x[150:].mean(axis=0), atol=1e-6)
    assert np.allclose(found.variances[0], x[:150].var(axis=0), atol=1e-6)
    far = mixture.diagonal_mixture(points, [[0.0, 0.0], [1e6, 1e6]], 3)  # a component without points stays
    assert far.weights[1] < 1e-6 or far.centers[1] == [1e6, 1e6]
    empty = mixture.diagonal_mixture(points.where("id < 0"), [[0.0, 0.0]], 3)
    assert empty.labels.count() == 0 and empty.log_likelihoods == []


def test_one_scan_folds_equal_separate_fits(spark, monkeypatch):
    x = DRAW.normal(size=(200, 3))
    rows = [(i, *map(float, r), float(r @ [1.0, -2.0, 0.5] + 3), i % 4) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (999, None, 1.0, 1.0, 1.0, 0)], "row_id long, a double, b double, c double, label double, fold int")
    names = ["a", "b", "c"]
    whole = df.where("a IS NOT NULL")
    for ridge in (False, True):
        found = fold_products.fold_scores(df, names, "label", "fold", [0.5, 20.0], ridge)
        monkeypatch.setattr(fold_products, "NARROW", 1)
        assert np.allclose(found, fold_products.fold_scores(df, names, "label", "fold", [0.5, 20.0], ridge))
        monkeypatch.undo()
        for penalty, number, score in found:
            fit = learners.fit_ridge if ridge else learners.fit_linear
            model = fit(whole.where(F.col("fold") != number), names, "label", penalty)
            held = whole.where(F.col("fold") == number).withColumn("prediction", model.predict())
            assert abs(regression_metrics(held, "label", "prediction").first().r2 - score) < 1e-9
    assert fold_products.fold_scores(df.where("row_id < 0"), names, "label", "fold", [1.0], True) == []


def test_only_refusals_of_a_learner_are_scores(table, monkeypatch):
    train, test = table.where("row_id % 5 > 0"), table.where("row_id % 5 = 0")
    rank = lambda: models.rank_candidates(train, test, ["a", "b"], True, ["naive_bayes"])[0].collect()
    tuned = lambda: models.tune("decision_tree", train, test, ["a", "b"], True, [{"maxDepth": 2}])
    folds = lambda: models._cv_scores("decision_tree", table.withColumn("_fold", F.col("row_id") % 2), ["a", "b"], True, "row_id")
    original = models.fit

    def failing(error):
        def fit(algorithm, *rest, **named):
            if algorithm == "baseline":
                return original(algorithm, *rest, **named)
            raise error

        monkeypatch.setattr(models, "fit", fit)

    failing(ValueError("one class only"))
    assert {(r.algorithm, r.status) for r in rank()} == {("naive_bayes", "error"), ("baseline", "ok")}
    assert tuned().best_score == float("-inf") and folds() == [0.0, 0.0]
    failing(RuntimeError("executor lost"))
    for run in (rank, tuned, folds):
        with pytest.raises(RuntimeError, match="executor lost"):
            run()


def test_a_learner_that_fails_in_a_task_is_told_from_a_broken_plan(table):
    checked = table.select(F.assert_true(F.col("a") > 100).alias("x"))
    with pytest.raises(Exception) as broken:
        checked.collect()
    assert not models.refused(broken.value) and models.refused(np.linalg.LinAlgError("singular"))
