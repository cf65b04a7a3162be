"""Profiling, scanning and cleaning on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from tabwright.operators import clean as C
from tabwright.operators import profile as P
from tabwright.operators import scan as S
from tabwright.operators import targets as G


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        (1.0, "a", 5.0, None, None),
        (2.0, "b", 5.0, 1.0, None),
        (None, "b", 5.0, 1.0, None),
        (4.0, None, 5.0, 1.0, None),
        (float("nan"), "a", 5.0, 1.0, None),
        (100.0, "c", 5.0, 1.0, None),
    ]
    return spark.createDataFrame(rows, "x double, w string, flat double, flat_or_blank double, blank double")


def test_profile_counts_a_blank_as_one_more_value(small):
    rows = {r.name: r for r in P.profile(small).collect()}
    assert (rows["x"].n_unique, rows["x"].n_missing, rows["x"].min, rows["x"].max) == (5, 2, 1.0, 100.0)
    assert (rows["w"].n_unique, rows["w"].n_missing, rows["w"].mean) == (4, 1, None)
    assert (rows["flat_or_blank"].n_unique, rows["blank"].n_unique) == (2, 1)
    assert rows["flat"].std == 0.0


def test_constants_are_flat_or_empty_but_not_flat_with_a_blank(small):
    assert {r.name for r in P.constant_columns(small).collect()} == {"flat", "blank"}


def test_typing_rules(spark):
    rows = [("1", "1", "x", "1d"), ("2.5e3", "x", "", "2"), ("-.5", "3", "x", "inf"), ("4", "", "x", "NaN")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    found = {r.name: (r.strict_type, r.majority_type) for r in P.column_typing(df, df.columns).collect()}
    assert found == {
        "a": ("numeric", "numeric"),
        "b": ("categorical", "numeric"),
        "c": ("categorical", "categorical"),
        "d": ("categorical", "categorical"),
    }


def test_histogram_of_a_constant_has_one_bin(spark):
    df = spark.createDataFrame([(2.0,)] * 7, "x double")
    assert [(r.bin, r.n) for r in P.histogram(df, "x").collect()] == [(0, 7)]


def test_histogram_keeps_empty_bins_and_closes_the_last(spark):
    df = spark.createDataFrame([(0.0,)] * 5 + [(10.0,)] * 4, "x double")
    found = {r.bin: r.n for r in P.histogram(df, "x").collect()}
    assert found == {0: 5, 1: 0, 2: 0, 3: 0, 4: 4}


def test_true_median_of_even_count(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 10, 20)], "x double")
    assert P.true_median(df, "x") == 6.0


def test_quality_score_rounds_half_up_and_never_goes_below_zero():
    assert S.quality_score(1000, 10, 5, 50, 0, 0, 0, 0, False, False, False) == 100  # 99.5
    assert S.quality_score(10, 2, 1, 20, 9, 9, 20, 9, True, True, True) == 0


def test_scan_of_a_small_table(small):
    row = S.scan(small).first()
    assert (row.total_missing, row.constant_columns, row.small_data) == (2 + 1 + 0 + 1 + 6, 2, True)


def test_target_rules_prefer_a_named_amount(spark):
    schema = "position int, name string, type string, n_unique long, n_missing long, min double, max double, mean double, std double"
    rows = [
        (0, "color", "categorical", 3, 0, None, None, None, None),
        (1, "status", "categorical", 5, 0, None, None, None, None),
        (2, "total_price", "numeric", 50, 0, 0.0, 9.0, 4.0, 2.0),
    ]
    df = spark.createDataFrame(rows, schema)
    assert G.suggest_target(df).first().name == "total_price"
    assert G.suggest_target(df.where("position < 2")).first().name == "status"
    assert G.suggest_target(df.where("position = 0")).first().rule == 3


def test_mode_ties_go_to_the_smaller_value(small):
    assert C.mode_values(small, ["w"])["w"] == ("a", 2)


def test_fill_strategies(small):
    auto = C.fill_missing(small, C.fill_values(small, "auto")).collect()
    assert [r.x for r in auto] == [1.0, 2.0, 4.0, 4.0, 4.0, 100.0]
    assert [r.w for r in auto] == ["a", "b", "b", "a", "a", "c"]
    assert C.fill_values(small, "zero")["w"] == ""
    assert C.fill_values(small, "mean")["x"] == pytest.approx(26.75)
    assert C.fill_values(small, "mean")["blank"] == 0.0
    with pytest.raises(ValueError):
        C.fill_values(small, "guess")


def test_drop_strategy_logs_the_rows(small):
    kept, log = C.handle_missing(small.select("x", "w"), "drop")
    assert (kept.count(), log.first().n_filled) == (3, 3)


def test_clip_keeps_blanks_and_skips_flat_columns(spark):
    rows = [(float(v), 1.0) for v in (1, 2, 3, 4, 5, 6, 7, 500)] + [(None, None)]
    df = spark.createDataFrame(rows, "x double, flat double")
    out, log = C.clip_outliers(df, ["x", "flat"])
    assert sorted((r.x for r in out.collect()), key=lambda v: (v is None, v)) == [1, 2, 3, 4, 5, 6, 7, 13.0, None]
    assert [(r.column, r.n_affected) for r in log.collect()] == [("x", 1)]


def test_sequential_and_joint_removal_differ(spark):
    rows = [(float(i), float(i)) for i in range(1, 9)] + [(1000.0, 9.0), (9.0, 40.0)] + [(500.0, 60.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    joint = C.remove_outliers(df, ["a", "b"])[0].count()
    sequential, log = C.remove_outliers(df, ["a", "b"], mode="sequential")
    assert joint == 8
    assert sequential.count() == 8
    assert {r.column: r.n_affected for r in log.collect()} == {"a": 2, "b": 1}


def test_scaling_a_constant_divides_by_one(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "x double, c double")
    rows = C.apply_scale(df, C.fit_scale(df, ["x", "c"])).collect()
    assert [(r.x, r.c) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]
    normal = C.normalize(df, ["x", "c"]).collect()
    assert [(r.x, r.c) for r in normal] == [(0.0, 3.0), (1.0, 3.0)]


def test_duplicates_are_counted_and_dropped(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), (None, 1), (None, 1), ("b", 2)], "w string, n int")
    assert P.duplicate_rows(df).first().n_duplicates == 3
    assert C.drop_duplicates(df).count() == 3


def test_category_counts_mark_rare_ones(spark):
    df = spark.createDataFrame([("a",)] * 97 + [("b",)] * 2 + [("c",)] + [(None,)], "w string")
    rows = {r.category: r.rare for r in P.category_counts(df, "w").collect()}
    assert rows == {"a": False, "b": True, "c": True}


def test_recommendations_for_high_missing(spark):
    df = spark.createDataFrame([(float(i), None if i < 5 else 1.0 * i) for i in range(12)], "a double, b double")
    rows = {r.rule: r for r in G.recommendations(df).collect()}
    assert (rows["missing"].severity, rows["missing"].columns, rows["missing"].action) == ("high", "b", "median")


def test_column_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (3.0, "y"), (50.0, None)], "`a.b c` double, `w w` string")
    assert P.profile(df).count() == 2
    assert S.scan(df).first().total_missing == 1
    assert C.fill_missing(df, C.fill_values(df)).where(F.col("`w w`") == "y").count() == 3
