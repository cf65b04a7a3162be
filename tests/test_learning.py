"""Encoders, learners, metrics, explanations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import evaluate as E
from tabwright.operators import explain as X
from tabwright.operators import features as T
from tabwright.operators import learners as L
from tabwright.operators import models as M
from tabwright.operators import score as S
from tabwright.operators import text as W


@pytest.fixture(scope="module")
def plane(spark):
    """y = 3 + 2a - b exactly, with a row key."""
    random = np.random.default_rng(5)
    rows = [(i, *(float(v) for v in random.normal(size=2))) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    return df.withColumn("label", 3 + 2 * F.col("a") - F.col("b")).persist()


def test_linear_fit_recovers_the_plane(plane):
    model = L.fit_linear(plane, ["a", "b"], "label", penalty=0.0)
    assert model.coefficients == pytest.approx([3.0, 2.0, -1.0])
    assert dict(model.importance()) == pytest.approx({"a": 2 / 3, "b": 1 / 3})


def test_wide_and_narrow_products_agree(plane, monkeypatch):
    narrow = L.cross_products(plane, ["a", "b"], "label")
    monkeypatch.setattr(L, "NARROW", 1)
    wide = L.cross_products(plane, ["a", "b"], "label")
    assert np.allclose(narrow[0], wide[0]) and np.allclose(narrow[1], wide[1])


def test_ridge_shrinks_slopes(plane):
    model = L.fit_ridge(plane, ["a", "b"], "label", penalty=1e6)
    assert max(abs(c) for c in model.coefficients[1:]) < 0.01


def test_attributions_add_up_and_match_the_closed_form(plane):
    model = L.LinearModel(["a", "b"], [3.0, 2.0, -1.0])
    score = lambda df: df.withColumn("prediction", model.predict())
    few, background = plane.where("row_id < 20"), plane.where("row_id >= 350")
    general = {(r.row_id, r.feature): r for r in X.attributions(few, ["row_id"], background, ["a", "b"], score).collect()}
    closed = {(r.row_id, r.feature): r for r in X.linear_attributions(few, ["row_id"], model, background).collect()}
    assert general.keys() == closed.keys()
    for key, row in general.items():
        assert row.attribution == pytest.approx(closed[key].attribution, abs=1e-9)
        assert row.base == pytest.approx(closed[key].base)
    for i in range(20):
        parts = [general[i, f] for f in ("a", "b")]
        assert sum(p.attribution for p in parts) == pytest.approx(parts[0].prediction - parts[0].base)


def test_attributions_of_a_product_add_up_too(plane):
    score = lambda df: df.withColumn("prediction", F.col("a") * F.col("b") + F.exp("a"))
    rows = X.sampled_attributions(plane, ["row_id"], ["a", "b"], score, "global")
    sums = rows.groupBy("row_id").agg(F.sum("attribution").alias("s"), F.first("prediction").alias("p"), F.first("base").alias("b")).collect()
    assert len(sums) == 60
    for r in sums:
        assert r.s == pytest.approx(r.p - r.b, abs=1e-8)


def test_local_surrogate_recovers_linear_weights_and_repeats(plane):
    score = lambda df: df.withColumn("prediction", 3 + 2 * F.col("a") - F.col("b"))
    instances = plane.where("row_id < 3")
    run = lambda d: {(r.row_id, r.feature): r.weight for r in X.local_surrogate(d, ["row_id"], plane, ["a", "b"], score).collect()}
    first = run(instances)
    assert run(instances.repartition(3)) == pytest.approx(first)
    # the surrogate has no free intercept, so the constant 3 leaks a little into the weights
    flat = X.local_surrogate(instances, ["row_id"], plane, ["a", "b"], lambda df: df.withColumn("prediction", 2 * F.col("a") - F.col("b")))
    for r in flat.collect():
        assert r.weight == pytest.approx({"a": 2.0, "b": -1.0}[r.feature], abs=0.01)


def test_class_shares_sum_to_one(plane):
    score = lambda df: df.withColumn("prediction", F.when(F.col("a") > 0, 1.0).otherwise(0.0))
    rows = X.class_shares(plane.where("row_id < 4"), ["row_id"], plane, ["a", "b"], score)
    for r in rows.groupBy("row_id").agg(F.sum("share").alias("s")).collect():
        assert r.s == pytest.approx(1.0)


def test_waterfall_bars_join_up(plane):
    model = L.LinearModel(["a", "b"], [3.0, 2.0, -1.0])
    rows = X.waterfall(X.linear_attributions(plane.limit(1), ["row_id"], model), ["row_id"]).orderBy("place").collect()
    assert rows[0].width >= rows[1].width


def test_naive_bayes_separates_clouds(spark):
    random = np.random.default_rng(2)
    rows = [(float(c), float(random.normal(10 * c)), float(random.normal(-10 * c))) for c in (0, 1, 2) for _ in range(30)]
    df = spark.createDataFrame(rows, "label double, x double, y double")
    model = L.fit_naive_bayes(df, ["x", "y"], "label")
    assert df.where(model.predict() == F.col("label")).count() == 90


def test_baseline(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (2.0,), (1.0,), (5.0,)], "label double")
    assert L.fit_baseline(df, "label", True).value == 1.0
    assert L.fit_baseline(df, "label", False).value == pytest.approx(2.2)


def test_encoder_handles_unseen_and_blank_values(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "b", "x" * 30, 1, "yes"), (2, None, "a", "y" * 30, 2, "no"), (3, 4.0, "c", "z" * 30, 3, "yes")],
        "k int, size double, color string, story string, paid int, answer string",
    )
    encoder = T.fit_encoder(df, "answer", keys=["k"])
    assert (encoder.numbers, encoder.encoding, encoder.texts, encoder.leaks) == (["size"], {"color": ["a", "b", "c"]}, ["story"], ["paid"])
    assert encoder.labels == ["no", "yes"]
    new = spark.createDataFrame([(9, "c"), (8, "never seen")], "k int, color string")
    rows = {r.k: (r["size"], r.color_b, r.color_c) for r in encoder.encode(new, ["k"]).collect()}
    assert rows == {9: (0.0, 0.0, 1.0), 8: (0.0, 0.0, 0.0)}
    assert [r.label for r in encoder.training(df, ["k"]).orderBy("key_k").collect()] == [1.0, 0.0, 1.0]


def test_too_many_categories_are_refused_wide_and_served_long(spark):
    df = spark.range(50).select("id", F.concat(F.lit("v"), F.col("id")).alias("w"))
    with pytest.raises(ValueError):
        T.categories(df, "w", most=20)
    assert T.one_hot_long(df, ["id"], ["w"]).count() == 49


def test_regression_metrics_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "label double, prediction double")
    row = E.regression_metrics(df, "label", "prediction").first()
    assert (row.r2, row.mae, row.rmse) == (0.0, 1.0, 1.0)


def test_macro_f1_comes_from_macro_precision_and_recall(spark):
    rows = [(0.0, 0.0)] * 8 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 1 + [(1.0, 0.0)] * 3
    row = E.classification_metrics(spark.createDataFrame(rows, "label double, prediction double"), "label", "prediction").first()
    p, r = (8 / 11 + 1 / 3) / 2, (8 / 10 + 1 / 4) / 2
    assert (row.accuracy, row.precision, row.recall) == (pytest.approx(9 / 14), pytest.approx(p), pytest.approx(r))
    assert row.f1_macro == pytest.approx(2 * p * r / (p + r))


def test_stratified_folds_are_even_and_never_exceed_the_smallest_class(spark):
    df = spark.createDataFrame([(i, "a" if i < 17 else "b") for i in range(20)], "k long, c string")
    folds = E.stratified_folds(df, "c", "k")
    assert folds.select("fold").distinct().count() == 3
    sizes = [r["count"] for r in folds.groupBy("c", "fold").count().collect()]
    assert set(sizes) <= {5, 6, 1}
    assert E.stratified_folds(df.limit(3), "c", "k") is None


def test_grades_follow_the_cut_offs(spark):
    rows = [("r2", 0.29), ("r2", 0.6), ("r2", 0.95), ("accuracy", 0.69), ("davies_bouldin", 2.5), ("davies_bouldin", 0.4), ("rmse", 3.0)]
    df = spark.createDataFrame(rows, "m string, v double")
    found = [r.g for r in df.select(E.grade(F.col("m"), F.col("v")).alias("g")).collect()]
    assert found == ["poor", "good", "excellent", "fair", "poor", "excellent", None]


def test_thinned_ranges_keep_both_ends():
    assert M.range_values(1, 30, 1) == [1, 5, 9, 13, 17, 21, 25, 29, 30]
    assert M.range_values(5, 8, 1) == [5, 6, 7, 8]
    assert len(list(M.parameter_grid(M.TUNABLE["random_forest"]))) == len(M.range_values(3, 50, 1)) * len(M.range_values(2, 15, 1))
    assert M.random_parameters(M.TUNABLE["svm"], 5) == M.random_parameters(M.TUNABLE["svm"], 5)


def test_candidates_are_ranked_and_failures_kept(plane):
    train, test = plane.where("row_id < 300"), plane.where("row_id >= 300")
    board, fitted = M.rank_candidates(train, test, ["a", "b"], False, ["decision_tree", "linear_regression", "no_such_thing"])
    rows = [(r.algorithm, r.status) for r in board.collect()]
    assert rows[0] == ("linear_regression", "ok")
    assert ("no_such_thing", "error") in rows and ("baseline", "ok") in rows
    assert set(fitted) == {"linear_regression", "decision_tree", "baseline"}


def test_knn_learner_votes(plane):
    train = plane.withColumn("label", F.when(F.col("a") > 0, 1.0).otherwise(0.0))
    fitted = M.fit("knn", train.where("row_id < 300"), ["a", "b"], True)
    scored = fitted.predict(train.where("row_id >= 300"))
    assert scored.count() == 100
    assert scored.where("label = prediction").count() >= 90


def test_tuning_keeps_the_original_without_a_gain(plane):
    train, test = plane.where("row_id < 300"), plane.where("row_id >= 300")
    tuning = M.tune("ridge_regression", train, test, ["a", "b"], False, [{"lambda": 10.0}, {"lambda": 0.01}], 0.5)
    assert tuning.best_params == {"lambda": 0.01}
    assert M.apply_best("ridge_regression", tuning, train, ["a", "b"], False) is not None
    tuning.original_score = 2.0
    assert M.apply_best("ridge_regression", tuning, train, ["a", "b"], False) is None


def test_scoring_extras(spark):
    df = spark.createDataFrame([(-5.0, None, ""), (2.0, 1.0, "")], "prediction double, x double, w string")
    assert [r.prediction for r in S.clamp_non_negative(df, 0.0).collect()] == [0.0, 2.0]
    assert [r.prediction for r in S.clamp_non_negative(df, -1.0).collect()] == [-5.0, 2.0]
    assert [r.input_empty for r in S.flag_empty_input(df, ["x", "w"]).collect()] == [True, False]
    assert [r.prediction for r in S.decode(df.withColumn("prediction", F.lit(1.0)), ["no", "yes"]).collect()] == ["yes", "yes"]


def test_word_weights_have_length_one_and_skip_common_words(spark):
    df = spark.createDataFrame([(1, "The red fox, the RED fox"), (2, "a blue fox"), (3, ""), (4, "green")], "id long, t string")
    rows = W.tfidf(df, "id", "t").collect()
    terms = {r.term for r in rows}
    assert {"red", "fox", "red fox", "fox red", "blue fox", "green"} <= terms and "the" not in terms
    for i in (1, 2, 4):
        assert sum(r.weight**2 for r in rows if r.id == i) == pytest.approx(1.0)


def test_candidate_counts_hold_the_whole_vocabulary(spark):
    """Keys that repeat or are blank, words in nearly all texts, ties at the last place: as counting every term."""
    words = [f"w{i * i % 31}" for i in range(400)]
    texts = [(i // 2 if i % 9 else None, " ".join(["same", *words[i * 5 : i * 5 + 9], "same", "pair"])) for i in range(40)]
    df = spark.createDataFrame([*texts, (99, None), (100, "")], "id long, t string")
    n = df.count()
    whole = W.term_counts(df, "id", "t")
    for most, share in ((5, 0.95), (12, 0.4), (25, 0.95), (5_000, 0.95)):
        wanted = W.vocabulary(whole, n, most, share)
        held = W.candidate_counts(df, "id", "t", n, most, share)
        assert {tuple(r) for r in W.vocabulary(held, n, most, share).collect()} == {tuple(r) for r in wanted.collect()}
        kept = held.join(wanted.select("term"), "term").select("id", "term", "tf")
        assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in whole.join(wanted.select("term"), "term").select("id", "term", "tf").collect()}
    assert W.candidate_counts(df, "id", "t", n, 5, 0.95).select("term").distinct().count() < whole.select("term").distinct().count() / 4


def test_learners_get_few_partitions(spark, monkeypatch):
    seen = []
    plain = M.Pipeline.fit

    def watched(self, df, *rest):
        seen.append(df.rdd.getNumPartitions())
        return plain(self, df, *rest)

    monkeypatch.setattr(M.Pipeline, "fit", watched)
    df = spark.range(60).select((F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0).alias("label")).repartition(40)
    M.fit("decision_tree", df, ["x"], False, {"maxDepth": 2})
    assert seen and seen[0] <= spark.sparkContext.defaultParallelism
    assert M.gathered(df, M.PARTITION_NUMBERS, 20).rdd.getNumPartitions() == 20


def test_text_matrix_with_repeats_and_nulls(spark):
    rows = [(1, "a", 0.5), (1, "a", 0.25), (1, "b", None), (2, None, 1.0), (None, "b", 2.0), (3, "z", 1.0)]
    found = W.text_matrix(spark.createDataFrame(rows, "doc_id long, term string, weight double"), "doc_id", ["a", "b"])
    assert {tuple(r) for r in found.collect()} == {(1, 0.75, 0.0), (2, 0.0, 0.0), (None, 0.0, 2.0), (3, 0.0, 0.0)}


@pytest.mark.parametrize("classification", [False, True])
def test_depths_of_a_tuned_tree_share_one_tree(spark, monkeypatch, classification):
    """Scores are those of a tree grown for each combination; one is grown for each number of least rows."""
    draw = np.random.default_rng(4)
    xs = draw.normal(size=(400, 3))
    ys = np.sin(3 * xs[:, 0]) + xs[:, 1] ** 2 + draw.normal(scale=0.1, size=400)
    ys = (ys > 0.8).astype(float) if classification else ys
    rows = [(i, *map(float, x), float(y)) for i, (x, y) in enumerate(zip(xs, ys, strict=True))]
    rows.append((400, float("nan"), None, 0.5, 1.0))
    df = spark.createDataFrame(rows, "row_id long, `a b` double, b double, c double, label double").repartition(3)
    train, test = df.where("row_id % 4 > 0"), df.where("row_id % 4 = 0")
    names = ["a b", "b", "c"]
    grid = [{"maxDepth": d, "minSamples": m} for d, m in ((2, 2), (7, 2), (4, 3), (5, 20), (2, 20), (25, 2))] + [{"maxDepth": 40, "minSamples": 9}]
    measure = E.classification_metrics if classification else E.regression_metrics
    wanted = {}
    for number, params in enumerate(grid[:-1]):
        held = measure(M.fit("decision_tree", train, names, classification, params).predict(test), "label", "prediction")
        wanted[number] = held.first()["accuracy" if classification else "r2"]
    grown, fit = [], M.fit
    monkeypatch.setattr(M, "fit", lambda *given: grown.append(given[4]) or fit(*given))
    tuning = M.tune("decision_tree", train, test, names, classification, grid)
    assert len([g for g in grown if g["maxDepth"] < 40]) == 2
    found = {r.trial: r.score for r in tuning.trials.collect()}
    assert found.pop(6) == float("-inf")
    assert found == pytest.approx(wanted)
