"""Neighbours, clusters and anomalies against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.functions.vectors import block_distances, pairwise
from tabwright.operators import anomaly as A
from tabwright.operators import cluster as K
from tabwright.operators.projection import pca
from tabwright.operators.neighbors import nearest


def frame(spark, matrix):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(matrix)], "id long, vec array<double>")


def distances(matrix):
    return np.sqrt(((matrix[:, None, :] - matrix[None, :, :]) ** 2).sum(axis=2))


def brute(matrix, k, same):
    d = distances(matrix)
    out = {}
    for i, row in enumerate(d):
        order = sorted((v, j) for j, v in enumerate(row) if not (same and i == j))
        out[i] = [j for _, j in order[:k]]
    return out


@pytest.fixture(scope="module")
def clouds():
    random = np.random.default_rng(8)
    parts = [random.normal(c, 0.3, size=(60, 2)) for c in ((0, 0), (5, 5), (0, 6))]
    copies = np.tile([[9.0, 9.0]], (90, 1))
    return np.vstack([*parts, copies, [[30.0, -30.0]]])


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize(("block_rows", "pivots"), [(1000, 1), (1000, 16), (13, 16), (7, 1)])
def test_nearest_with_a_third_of_the_rows_equal(spark, clouds, same, block_rows, pivots):
    points = frame(spark, clouds)
    import tabwright.operators.neighbors as N

    held, N.ROWS_PER_PIVOT = N.ROWS_PER_PIVOT, 1
    try:
        found = nearest(points, points, 4, same=same, block_rows=block_rows, max_pivots=pivots).collect()
    finally:
        N.ROWS_PER_PIVOT = held
    got = {}
    for r in sorted(found, key=lambda r: (r.id, r["rank"])):
        got.setdefault(r.id, []).append(r.neighbor)
    assert got == brute(clouds, 4, same)


def test_nearest_asks_for_more_than_there_is(spark):
    points = frame(spark, np.array([[0.0], [1.0], [3.0]]))
    found = nearest(points, points, 10, same=True)
    assert found.groupBy("id").count().where("count = 2").count() == 3


def test_sampled_silhouette_holds_its_bounds(spark):
    draws = np.random.default_rng(5)
    centers = draws.normal(size=(4, 3)) * 4
    groups = [0] * 900 + [1] * 250 + [2] * 40 + [3]  # most rows in one cluster, one row alone
    rows = [(i, [float(v) for v in centers[c] + draws.normal(size=3)]) for i, c in enumerate(groups)]
    points = spark.createDataFrame(rows, "id long, vec array<double>")
    labels = spark.createDataFrame(list(enumerate(groups)), "id long, cluster int")
    exact = {r.id: r.silhouette for r in K.silhouette_rows(points, labels).collect()}
    got = {r.id: r for r in K.silhouette_sampled_rows(points, labels, 128, block_rows=100).collect()}
    assert got.keys() == exact.keys() and len(got) == 1190
    every = [i for i in exact if i % 50 == 0]
    assert all(got[i].low - 1e-9 <= exact[i] <= got[i].high + 1e-9 for i in every)
    assert all(r.low <= r.silhouette <= r.high for r in got.values())
    assert np.mean([abs(got[i].silhouette - exact[i]) for i in exact]) < 0.02
    assert any(got[i].low < got[i].high for i in every)
    whole = {r.id: r for r in K.silhouette_sampled_rows(points, labels, 900).collect()}
    assert all(abs(whole[i].silhouette - s) < 1e-9 and whole[i].low == whole[i].high for i, s in exact.items())
    summary = K.silhouette_sampled(points, labels, 128).first()
    assert summary.n == 1190 and summary.low < np.mean(list(exact.values())) < summary.high
    assert K.cluster_metrics(points, labels, "silhouette_sampled").keys() >= {"silhouette_sampled"}
    assert K.silhouette_sampled(points.where("false"), labels).first().n == 0


def test_silhouette_matches_brute_force_in_small_blocks(spark, clouds):
    labels = np.array([0] * 60 + [1] * 60 + [2] * 60 + [3] * 90 + [-1])
    d = distances(clouds)
    wanted = {}
    for i in range(len(clouds)):
        if labels[i] < 0:
            continue
        mine = [d[i, j] for j in range(len(clouds)) if labels[j] == labels[i] and j != i]
        a = np.mean(mine)
        b = min(np.mean(d[i, labels == c]) for c in set(labels) - {-1, labels[i]})
        wanted[i] = (b - a) / max(a, b) if b > a else 0.0
    marks = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "id long, cluster int")
    got = {r.id: r.silhouette for r in K.silhouette_rows(frame(spark, clouds), marks, block_rows=17).collect()}
    assert got == pytest.approx(wanted)


def flooded(matrix, eps, min_pts):
    """Clusters of core points by flooding; borders to the cluster with the smallest first core id."""
    d = distances(matrix) <= eps
    core = d.sum(axis=1) >= min_pts
    label = np.full(len(matrix), -1)
    number = 0
    for i in range(len(matrix)):
        if core[i] and label[i] < 0:
            waiting, label[i] = [i], number
            while waiting:
                j = waiting.pop()
                for t in np.nonzero(d[j] & core & (label < 0))[0]:
                    label[t] = number
                    waiting.append(t)
            number += 1
    for i in np.nonzero(~core)[0]:
        near = label[d[i] & core]
        label[i] = near.min() if len(near) else -1
    return label


@pytest.mark.parametrize("block_rows", [2000, 11])
def test_dbscan_matches_brute_force(spark, clouds, block_rows):
    found = K.dbscan(frame(spark, clouds), 4, eps=0.35, block_rows=block_rows)
    got = {r.id: r.cluster for r in found.labels.collect()}
    wanted = flooded(clouds, 0.35, 4)
    assert got == dict(enumerate(wanted))
    assert got[len(clouds) - 1] == -1


def test_dbscan_follows_a_long_chain(spark):
    chain = np.array([[0.5 * i, 0.0, 0.0, 1.0] for i in range(150)])
    found = K.dbscan(frame(spark, chain), 3, eps=0.6)
    assert found.labels.where("cluster = 0").count() == 150


def test_components_of_a_path_and_a_ring(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "id long")
    edges = [(i, i + 1) for i in range(19)] + [(20 + i, 20 + (i + 1) % 10) for i in range(10)]
    found = {r.id: r.component for r in K.connected(nodes, spark.createDataFrame(edges, "id long, to long")).collect()}
    assert found == {i: 0 if i < 20 else 20 if i < 30 else i for i in range(40)}


def test_local_outlier_factor_matches_brute_force(spark):
    random = np.random.default_rng(4)
    matrix = np.vstack([random.normal(size=(60, 3)), [[9.0, 9.0, 9.0]]])
    k, d = 5, distances(matrix)
    near = {i: sorted((v, j) for j, v in enumerate(row) if j != i)[:k] for i, row in enumerate(d)}
    reach = {i: rows[-1][0] for i, rows in near.items()}
    lrd = {i: k / sum(max(reach[j], v) for v, j in rows) for i, rows in near.items()}
    wanted = {i: sum(lrd[j] for _, j in rows) / k / lrd[i] for i, rows in near.items()}
    got = {r.id: r.score for r in A.local_outlier_scores(frame(spark, matrix), k).collect()}
    assert got == pytest.approx(wanted)
    flagged = A.local_outliers(frame(spark, matrix), k).where("anomaly").collect()
    assert 60 in {r.id for r in flagged} and len(flagged) == 6


def test_isolation_forest_finds_the_far_point_and_repeats(spark):
    random = np.random.default_rng(6)
    matrix = np.vstack([random.normal(size=(300, 2)), [[12.0, 12.0]]])
    first = {r.id: r.score for r in A.isolation_forest(frame(spark, matrix), trees=30).collect()}
    again = {r.id: r.score for r in A.isolation_forest(frame(spark, matrix).repartition(5), trees=30).collect()}
    assert first == again
    assert max(first, key=first.get) == 300
    flagged = A.isolation_forest(frame(spark, matrix), trees=30).where("anomaly").count()
    assert flagged >= 30


def test_zscore_of_a_constant_finds_nothing(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "k int, x double")
    assert A.zscore_anomalies(df, ["k"], ["x"]).count() == 0


def test_explained_shares_sum_to_one(spark, clouds):
    scores, shares = pca(frame(spark, clouds))
    assert sum(shares) == pytest.approx(1.0)
    assert scores.count() == len(clouds)


def test_nearest_center(spark):
    out = K.assign(frame(spark, np.array([[0.0, 0.0], [9.0, 9.0]])), [[1.0, 0.0], [9.0, 8.0]])
    assert [(r.cluster, r.distance) for r in out.orderBy("id").collect()] == [(0, 1.0), (1, 1.0)]


def test_groupings_find_the_clouds(spark, clouds):
    points = frame(spark, clouds[:180])
    for method in (K.kmeans, K.hierarchical, K.gaussian_mixture):
        found = K.cluster_with(method, points, k=3)
        sizes = sorted(r["count"] for r in found.labels.groupBy("cluster").count().collect())
        assert sizes == [60, 60, 60]
    metrics = K.cluster_metrics(points, K.kmeans(points, 3).labels)
    assert metrics["silhouette"] > 0.8 and metrics["davies_bouldin"] < 0.5


def test_squares_for_one_cluster(spark, clouds):
    points = frame(spark, clouds[:10])
    one = points.select("id", F.lit(0).alias("cluster"))
    assert K.silhouette(points, one).first().silhouette == 0.0
    assert K.silhouette_squared(points, one) == 0.0
    summaries = K.cluster_summaries(points, one)
    assert K.calinski_harabasz(summaries).first().calinski_harabasz == 0.0
    assert K.davies_bouldin(summaries).first().davies_bouldin == float("inf")


def test_the_measure_is_the_callers_choice_and_keeps_its_name(spark):
    rows = [(i, [float(i % 2) * 10 + 0.01 * i, 0.0]) for i in range(20)]
    points = spark.createDataFrame(rows, "id long, vec array<double>")
    by_k, best = K.find_k(points, 3, measure="silhouette_squared")
    assert best == 2 and "silhouette_squared" in by_k.columns and "silhouette" not in by_k.columns
    labels = K.kmeans(points, 2).labels
    assert K.cluster_metrics(points, labels)["silhouette"] < K.cluster_metrics(points, labels, "silhouette_squared")["silhouette_squared"]
    with pytest.raises(ValueError):
        K.cluster_metrics(points, labels, "other")


def test_density_clusters_give_every_center_as_a_row(spark):
    rows = [(i, [float(i // 4) * 100, float(i % 4)]) for i in range(40)]
    points = spark.createDataFrame(rows, "id long, vec array<double>")
    found = K.dbscan(points, 2, eps=1.5)
    centers = {r.center[0]: (r.n, r.center[1]) for r in found.centers.collect()}
    assert centers == {float(g) * 100: (4, 1.5) for g in range(10)}


def test_block_distances_are_those_gap_by_gap():
    draw = np.random.default_rng(3)
    a, b = draw.normal(1e4, 1, (40, 24)), draw.normal(1e4, 1, (50, 24))
    b[:10] = a[:10]
    b[10:20] = a[10:20] + 1e-6
    found, wanted = block_distances(a, b), pairwise(a, b)
    assert (np.abs(found - wanted) <= 1e-11 * wanted).all()
    a[0, 0], b[0, 1] = np.inf, 1e200
    with np.errstate(over="ignore", invalid="ignore"):
        assert np.array_equal(block_distances(a, b), pairwise(a, b), equal_nan=True)


def test_distance_sums_take_long_blocks_in_slices(monkeypatch):
    """The left side is measured a few rows at a time, whatever its length."""
    draw = np.random.default_rng(4)
    frame = pd.DataFrame({"id": range(900), "vec": list(draw.normal(size=(900, 8))), "cluster": draw.integers(0, 3, 900)})
    most = []
    monkeypatch.setattr(K, "block_distances", lambda x, y: most.append(x.shape[0] * y.shape[0]) or block_distances(x, y))
    sums = K._distance_sums(frame, frame)
    assert max(most) <= K.SUM_CELLS
    gaps = pairwise(np.array(list(frame["vec"])), np.array(list(frame["vec"])))
    wanted = np.stack([gaps[:, frame["cluster"] == c].sum(axis=1) for c in range(3)], axis=1)
    assert np.allclose(sums["s"].to_numpy().reshape(900, 3), wanted, rtol=1e-12)


def test_visits_are_handed_on_in_bounded_frames():
    import pandas as pd

    from tabwright.operators import neighbors as N

    draw = np.random.default_rng(4)
    pivots, rows = draw.normal(size=(100, 32)), draw.normal(size=(2_000, 32))
    frame = pd.DataFrame({"id": range(2_000), "vec": list(rows), "reach": np.inf})
    made = list(N._visits(pivots, np.full(100, 9.0))([frame]))
    assert max(len(f) for f in made) * 32 <= N.VISIT_NUMBERS
    seen = pd.concat(made)
    assert len(seen) == 2_000 * 99 and not seen.duplicated(["id", "cell"]).any()
    assert all((v == rows[i]).all() for i, v in zip(seen["id"][::997], seen["vec"][::997], strict=True))


def brute_silhouettes(matrix, labels):
    """Per clustered row that is not alone; negatives are 0."""
    d, out = distances(matrix), {}
    for i in np.flatnonzero(labels >= 0):
        mine = (labels == labels[i]) & (np.arange(len(labels)) != i)
        others = set(labels.tolist()) - {-1, int(labels[i])}
        if mine.any() and others:
            a, b = d[i, mine].mean(), min(d[i, labels == c].mean() for c in others)
            out[int(i)] = (b - a) / b if b > a else 0.0
    return out


def test_silhouette_of_many_clusters_hands_on_least_means(spark):
    """Two large clusters, which blocks share, 300 small ones, some rows alone or noise."""
    draw = np.random.default_rng(6)
    labels = np.array([0] * 70 + [1] * 45 + [2 + i // 2 for i in range(600)] + [400, 401, -1, -1])
    matrix = draw.normal(size=(len(labels), 2)) + np.maximum(labels, 0)[:, None] % 17
    marks = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "id long, cluster int")
    got = {r.id: r.silhouette for r in K.silhouette_rows(frame(spark, matrix), marks, block_rows=60).collect()}
    assert got == pytest.approx(brute_silhouettes(matrix, labels))
    right = pd.DataFrame({"id": range(600), "vec": list(matrix[115:715]), "cluster": labels[115:715], "n": 2})
    left = right.drop(columns="n")
    assert len(K._nearest_means(left, right)) == 2 * len(left)  # its own sum and the least mean, not 300 sums


def test_silhouettes_of_several_groupings_take_distances_once(spark, monkeypatch):
    draw = np.random.default_rng(7)
    matrix = draw.normal(size=(150, 2))
    every = [draw.integers(-1, k, 150) for k in (2, 3, 5)]
    points = frame(spark, matrix)
    marks = [spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "id long, cluster int") for labels in every]
    passes, pairs = [], K.block_pairs
    monkeypatch.setattr(K, "block_pairs", lambda *given, **named: passes.append(1) or pairs(*given, **named))
    found = K.silhouette_means(points, marks, block_rows=40)
    assert len(passes) == 1
    wanted = [np.mean(list(brute_silhouettes(matrix, labels).values())) for labels in every]
    assert found == pytest.approx(wanted)
    twice = points.unionByName(points)  # repeated ids are measured one grouping at a time, as before
    assert K.silhouette_means(twice, marks[:2]) == pytest.approx([K.silhouette(twice, m).first().silhouette for m in marks[:2]])


@pytest.mark.parametrize("numbers", [4_000_000, 2_000])
def test_long_vectors_are_searched_in_one_pass_of_the_base(spark, monkeypatch, numbers):
    """Cells rule out nothing, so no visits are sent; copies, ties and far rows are found as by brute force."""
    draw = np.random.default_rng(8)
    points = np.concatenate([draw.normal(size=(340, 24)), np.repeat(draw.integers(0, 2, (5, 24)), 6, axis=0), [np.full(24, 40.0)]])
    import tabwright.operators.neighbors as N

    streams, stream = [], N.streamed
    monkeypatch.setattr(N, "ROWS_PER_PIVOT", 1)
    monkeypatch.setattr(N, "streamed", lambda *given: streams.append(1) or stream(*given, piece_rows=50))
    monkeypatch.setattr(N, "STREAM_NUMBERS", numbers)
    got = nearest(frame(spark, points), frame(spark, points), 5, same=True, block_rows=10, max_pivots=16).collect()
    assert streams
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    ids = np.array([r.id for r in frame(spark, points).orderBy("id").collect()])
    wanted = {}
    for i, row in enumerate(gaps):
        order = [j for j in np.lexsort((ids, np.round(row, 9))) if j != i][:5]
        wanted[ids[i]] = [(ids[j], pytest.approx(row[j])) for j in order]
    found = {i: [] for i in wanted}
    for r in sorted(got, key=lambda r: (r.id, r["rank"])):
        found[r.id].append((r.neighbor, r.distance))
    assert found == wanted


def test_silhouettes_of_many_rows_are_summed_in_a_stream(spark, monkeypatch):
    """Beyond some blocks no sums per pair of blocks are handed on; repeated and missing ids come out as before."""
    draw = np.random.default_rng(9)
    cuts = np.repeat(np.arange(140), 5)
    matrix = np.concatenate([draw.normal(size=(690, 2)), draw.normal(size=(10, 2)) + 9])
    points = frame(spark, matrix).withColumn("id", F.when(F.col("id") == 5, 4).when(F.col("id") != 7, F.col("id")))
    for labels, clusters in ((draw.integers(-1, 4, 700), 4), (np.where(cuts > 120, 3, cuts), 121)):
        marks = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "id long, cluster int")
        monkeypatch.setattr(K, "MAX_SUMS", 100)
        paired = {r.id: r.silhouette for r in K.silhouette_rows(points, marks, block_rows=350).collect()}
        handed, stream = [], K.streamed
        monkeypatch.setattr(K, "streamed", lambda *given: handed.append(stream(*given)) or handed[-1])
        found = {r.id: r.silhouette for r in K.silhouette_rows(points, marks, block_rows=40).collect()}
        monkeypatch.setattr(K, "streamed", stream)
        assert found == pytest.approx(paired)
        assert handed[0].count() <= 700  # one row each, not one per block
