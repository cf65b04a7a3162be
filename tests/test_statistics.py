import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.functions.ranking import numbered
from tabwright.functions.sampling import evenly_spread, pick, train_test
from tabwright.functions.statistics import correlation_pairs, iqr_bounds, order_stats

SHAPES = {
    "spread": lambda r: r.normal(size=5000),
    "long_tail": lambda r: np.exp(r.normal(size=5000) * 4),
    "one_value_has_a_third": lambda r: np.where(r.random(5000) < 0.34, 7.0, r.normal(size=5000) * 10),
    "few_values": lambda r: r.integers(0, 4, 5000).astype(float),
    "constant": lambda r: np.full(5000, 3.25),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("exact_rows", [10_000, 300, 1])
def test_order_stats_equal_the_sorted_values(spark, shape, exact_rows):
    values = SHAPES[shape](np.random.default_rng(1))
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    wanted = (0.0, 0.05, 0.25, 0.5, 0.75, 0.99)
    found = order_stats(df, {"x": wanted}, exact_rows=exact_rows, accuracy=50)["x"]
    ordered = np.sort(values)
    assert found == {p: ordered[math.floor(len(values) * p)] for p in wanted}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8])
def test_order_stats_take_the_upper_median_and_skip_blanks(spark, n):
    rows = [(float(i),) for i in range(n)] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "x double")
    assert order_stats(df, {"x": (0.5,)})["x"][0.5] == float(n // 2)


def test_order_stats_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert order_stats(df, {"x": (0.5,)})["x"][0.5] is None


def test_bounds_need_four_values_and_can_skip_flat_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, None, 5.0), (3.0, 2.0, 5.0), (4.0, 3.0, 5.0)], "a double, b double, c double")
    assert iqr_bounds(df, ["a", "b", "c"]) == {"a": (2.0 - 3.0, 4.0 + 3.0), "c": (5.0, 5.0)}
    assert set(iqr_bounds(df, ["a", "b", "c"], skip_flat=True)) == {"a"}


def test_correlation_is_zero_for_a_constant_and_pairwise_complete(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 8.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r.x, r.y): (r.n, r.r) for r in correlation_pairs(df, [("a", "b"), ("a", "c")]).collect()}
    assert found["a", "b"] == (3, pytest.approx(1.0))
    assert found["a", "c"] == (4, 0.0)


@pytest.mark.parametrize("ascending", [True, False])
def test_numbers_match_one_big_window(spark, ascending):
    random = np.random.default_rng(3)
    rows = [
        (int(i), "hot" if random.random() < 0.4 else f"k{i % 7}", None if i % 50 == 0 else float(random.choice([1.0, 1.0, 1.0, random.normal()])))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    found = {r.id: r.n for r in numbered(df, [("v", ascending), ("id", True)], ["k"], "n", slices=16).collect()}

    def order(row):
        missing = row[2] is None
        return (missing, 0.0 if missing else (row[2] if ascending else -row[2]), row[0])

    wanted = {}
    for key in {r[1] for r in rows}:
        for place, row in enumerate(sorted((r for r in rows if r[1] == key), key=order), 1):
            wanted[row[0]] = place
    assert found == wanted


def test_numbers_over_the_whole_table(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("v"))
    found = {r.id: r.n for r in numbered(df, [("v", False), ("id", True)], name="n", slices=8).collect()}
    order = sorted(range(1000), key=lambda i: (-(i % 3), i))
    assert found == {i: place for place, i in enumerate(order, 1)}


def test_split_follows_the_key_not_the_row_order(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    train, test = train_test(df, ["k"])
    again, _ = train_test(df.orderBy(F.desc("k")).repartition(7), ["k"])
    assert {r.k for r in train.collect()} == {r.k for r in again.collect()}
    assert train.count() + test.count() == 2000
    assert 0.15 < test.count() / 2000 < 0.25


def test_samples_have_their_size(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    assert pick(df, ["k"], 60).distinct().count() == 60
    assert evenly_spread(df.limit(2000), ["k"]).count() == 2000
    assert 600 < evenly_spread(df, ["k"]).count() <= 800


def test_row_numbers_over_text_keys(spark):
    from tabwright.functions.ranking import numbered

    rows = [(1.0, f"model-{i:03d}") for i in range(60)] + [(2.0, "é"), (2.0, ""), (0.5, "z")]
    frame = spark.createDataFrame(rows, "score double, model_id string")
    found = numbered(frame, [("score", False), ("model_id", True)], slices=8).collect()
    wanted = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r.score, r.model_id) for r in sorted(found, key=lambda r: r.row_number)] == wanted
    byname = numbered(frame, [("model_id", True)], slices=8).collect()
    assert [r.model_id for r in sorted(byname, key=lambda r: r.row_number)] == sorted(r[1] for r in rows)


def test_counts_around_cuts_with_blanks_and_nan(spark):
    from tabwright.functions.statistics import _count_around

    values = [None, float("nan"), -0.0, 0.0, 1.0, 1.0, 2.0, float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    assert _count_around(rows, {"v": [0.0, 1.0, 5.0]}) == {("v", 0.0): (0, 2), ("v", 1.0): (2, 4), ("v", 5.0): (5, 5)}
    assert _count_around(rows.where("false"), {"v": [0.0]}) == {("v", 0.0): (0, 0)}
