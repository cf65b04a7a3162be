"""Every query against its SQL, and every inventory id against the queries."""

import os

import pytest

from tabwright.catalog import COVERS, ORACLE, QUERIES, load_all
from tests.compare import difference, duck

load_all()

FAMILIES = {
    "SRC": 9, "PRJ": 8, "PRO": 23, "CLN": 15, "FEA": 10, "JOI": 10, "AGG": 13, "WIN": 5, "SRT": 5, "SET": 3, "FUN": 11,
    "SUP": 13, "EVL": 11, "TUN": 5, "SCO": 7, "XAI": 12, "UNS": 12, "ANO": 5, "REG": 10, "UDF": 3,
}
# Rows-only queries that train many models: run with ALL_QUERIES=1.
SLOW = {
    "ranked_classifiers_quality", "ranked_regressors_price", "svm_quality", "svm_status", "gradient_boosting_quality",
    "logistic_regression_quality", "explored_part", "explored_points", "find_k_embeddings", "gradient_boosting_price",
    "trained_on_orders", "cross_validated_tree", "residuals_of_best", "tuned_tree_price", "stored_leaderboard",
}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf, name):
    if name in SLOW and not os.environ.get("ALL_QUERIES"):
        pytest.skip("slow; set ALL_QUERIES=1")
    assert QUERIES[name](spark, sf).count() > 0


def test_every_inventory_id_has_a_query():
    wanted = {f"{family}-{i}" for family, n in FAMILIES.items() for i in range(1, n + 1)}
    assert wanted - {i for ids in COVERS.values() for i in ids} == set()


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
