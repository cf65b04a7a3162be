"""Histogram trees and boosting beyond what SQL checks: draws, odd rows, falling loss, brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import histogram_trees as T
from tabwright.operators import models
from tabwright.sources import saved_models

DRAW = np.random.default_rng(9)


@pytest.fixture(scope="module")
def table(spark):
    x = DRAW.integers(0, 12, (240, 3)).astype(float)
    kind = ((x[:, 0] > 5).astype(int) + (x[:, 1] > 8)).astype(float)
    rows = [(i, *map(float, r), float(k), float(3 * r[0] - r[2])) for i, (r, k) in enumerate(zip(x, kind, strict=True))]
    return spark.createDataFrame(rows, "key long, a double, b double, c double, kind double, y double").repartition(3)


def brute_root(rows, features, label, tree=0):
    """The root's best cut over its drawn features by squared error."""
    best = (0.0, None, None)
    y = np.array([r[label] for r in rows])
    for f in T.feature_subset(len(features), tree, 1):
        x = np.array([r[features[f]] for r in rows])
        for cut in sorted(set(x)):
            low, high = y[x <= cut], y[x > cut]
            if len(low) and len(high):
                gain = y.var() - len(low) / len(y) * low.var() - len(high) / len(y) * high.var()
                if gain > best[0] + 1e-9:
                    best = (gain, features[f], cut)
    return best


def test_root_is_the_best_cut(table):
    features = ["a", "b", "c"]
    model = T.fit_forest(table, features, "y", False, max_depth=1)
    gain, feature, cut = brute_root(table.collect(), features, "y")
    root = model.nodes.table(table.sparkSession).where("node = 1").first()
    assert (root.feature, root.threshold) == (feature, cut) and math.isclose(root.gain, gain, rel_tol=1e-9)
    assert root.n == 240 and model.importance() == [(feature, 1.0)]


def test_forest_draws_by_key(table):
    times = T.draws(DRAW.integers(-(2**62), 2**62, 100_000), 3)
    assert abs(times.mean() - 1) < 0.02 and abs((times == 0).mean() - math.exp(-1)) < 0.01
    one, two = (T.fit_forest(t, ["a", "b", "c"], "kind", True, 3, 3, key="key").nodes for t in (table, table.repartition(7)))
    assert (one.feature, one.threshold, one.n) == (two.feature, two.threshold, two.n)
    assert len({one.n[r] for r in one.roots}) > 1
    with pytest.raises(ValueError):
        T.fit_forest(table, ["a"], "kind", True, 3)


def test_boosting_learns_three_classes(table):
    model = T.fit_boosting(table, ["a", "b", "c"], "kind", True, rounds=8, max_depth=3, learning_rate=0.3)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:], strict=False))
    assert len(model.nodes.roots) == 24
    scored = model.scores(model.predict(table)).collect()
    assert np.mean([r.prediction == r.kind for r in scored]) > 0.95
    assert all(r.prediction == float(np.argmax(r.scores)) for r in scored)


def test_boosting_of_values_starts_from_the_mean(table):
    model = T.fit_boosting(table, ["a", "b", "c"], "y", False, rounds=6)
    y = [r.y for r in table.collect()]
    assert math.isclose(model.losses[0], np.var(y), rel_tol=1e-9)
    assert all(b <= a for a, b in zip(model.losses, model.losses[1:], strict=False)) and model.losses[-1] < model.losses[0]
    error = model.predict(table).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    assert math.isclose(error, model.losses[-1], rel_tol=1e-9)


def test_odd_tables(spark, table):
    blank = spark.createDataFrame([(1, None, 0.0), (2, 1.0, 1.0), (3, 2.0, 0.0), (4, None, None)], "key long, a double, kind double")
    model = T.fit_forest(blank, ["a"], "kind", True, max_depth=3, min_samples=1)
    got = {r.key: r.prediction for r in model.predict(blank).collect()}
    assert got[2] == 1.0 and got[1] == got[4] == got[3] == 0.0  # a missing value goes right
    none = table.where("key < 0")
    for fit in (T.fit_forest, T.fit_boosting):
        for label, classes in (("kind", True), ("y", False)):
            empty = fit(none, ["a", "b"], label, classes)
            assert {r.prediction for r in empty.predict(table).collect()} == {0.0}
    same = T.fit_boosting(table.withColumn("kind", F.lit(2.0)), ["a"], "kind", True, rounds=2)
    assert {r.prediction for r in same.predict(table).collect()} == {2.0}


def test_saved_trees_score_alike(spark, table, tmp_path):
    train = table.withColumnsRenamed({"kind": "label", "key": "row_id"})
    for algorithm in ("histogram_tree", "histogram_forest", "histogram_boosting", "gradient_boosting"):
        fitted = models.fit(algorithm, train, ["a", "b", "c"], True, {"nTrees": 3, "maxDepth": 3})
        saved_models.export(spark, fitted, f"{tmp_path}/{algorithm}")
        _, again = saved_models.restore(spark, f"{tmp_path}/{algorithm}")
        one, two = ({r.row_id: r.prediction for r in m.predict(train).collect()} for m in (fitted, again))
        assert one == two and fitted.importance == again.importance


def test_training_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(i % 3)) for i in range(60)], "key long, a double, b double, y double")

    def passed(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    T.fit_forest(rows.mapInPandas(passed, rows.schema), ["a", "b"], "y", False, max_depth=3)
    assert seen.value == 60
    T.fit_boosting(rows.mapInPandas(passed, rows.schema), ["a", "b"], "y", False, rounds=2, max_depth=2)
    assert seen.value == 120


def test_bins_stand_for_values(spark):
    edges = [[0.0, 1.0, 2.5], [5.0]]
    values = [(0.0, 5.0), (-0.0, 5.5), (2.6, None), (None, float("nan")), (1.5, -1.0)]
    rows = spark.createDataFrame(values, "f0 double, f1 double").coalesce(1)
    coded = T._binned(rows, 2, edges).toPandas()
    assert T._matrix(coded, T._code_type(edges)).tolist() == [[0, 0], [0, 1], [3, 1], [3, 1], [2, 0]]
    assert T._code_type([[float(i) for i in range(300)]]).endswith("u2")
