"""Clustering, cluster quality, projection and reading of clusters.

Points are rows (id long, vec array<double>), labels are rows (id, cluster); cluster -1 is noise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import quoted, ratio
from tabwright.functions.ranking import numbered
from tabwright.functions.sampling import SEED
from tabwright.functions.statistics import order_stats
from tabwright.functions.vectors import FEW_COLUMNS, array_squared_distance, block_distances, pairwise, unpack
from tabwright.operators.neighbors import (
    BLOCK_ROWS,
    PIECE_ROWS,
    block_pairs,
    block_sizes,
    blocks_for,
    matrix,
    nearest,
    stream_blocks,
    streamed,
)
from tabwright.session import cut_lineage, ensure_checkpoint_dir, side_by_side, written

NOISE = -1
MAX_BROADCAST_CENTERS = 5_000
SAMPLE_PER_CLUSTER = 512
# Rows a side of the blocks that give sums of distances, least number of such blocks of BLOCK_ROWS, distances held at once.
SUM_ROWS = 8_000
SUM_BLOCKS = 6
SUM_CELLS = 1 << 18
# Blocks a side beyond which pairs of blocks would send, and hand on, more than a stream of all rows to each block.
PAIRED_BLOCKS = 8
# Distances of few columns are taken in tiles of so many rows a side, which stay in a core's cache.
TILE = (128, 1_024)
# Clusters of all groupings together whose sums a row keeps side by side; more are dealt out cluster by cluster.
MAX_SUMS = 256
# How well rows sit in their clusters, by name: Euclidean and exact (quadratic, in blocks), on squared distances
# (linear), or Euclidean against a sample of each cluster (linear).
MEASURES = ("silhouette", "silhouette_squared", "silhouette_sampled")


@dataclass
class Clustering:
    """A grouping of points: labels, and one center per cluster.

    Methods that are told the number of clusters list their centers; others, whose clusters grow
    with the table, give them as rows (cluster, n, center).
    """

    algorithm: str
    labels: DataFrame
    centers: list[list[float]] | DataFrame
    inertia: float | None = None
    weights: list[float] | None = None


def _features(points: DataFrame) -> DataFrame:
    return points.select("id", array_to_vector("vec").alias("features"))


def _labelled(model, points: DataFrame) -> DataFrame:
    return model.transform(_features(points)).select("id", F.col("prediction").alias("cluster"))


def kmeans(points: DataFrame, k: int, max_iter: int = 100, seed: int = SEED) -> Clustering:
    """K-Means with the parallel k-means++ start."""
    model = KMeans(k=k, maxIter=max_iter, seed=seed).fit(_features(points))
    centers = [[float(v) for v in c] for c in model.clusterCenters()]
    return Clustering("kmeans", _labelled(model, points), centers, float(model.summary.trainingCost))


def hierarchical(points: DataFrame, k: int, seed: int = SEED) -> Clustering:
    """Top-down hierarchy by repeated bisection; a bottom-up one is cubic and gives other groups."""
    model = BisectingKMeans(k=k, seed=seed).fit(_features(points))
    centers = [[float(v) for v in c] for c in model.clusterCenters()]
    return Clustering("hierarchical", _labelled(model, points), centers)


def gaussian_mixture(points: DataFrame, k: int, max_iter: int = 50, seed: int = SEED) -> Clustering:
    """Mixture with full covariances and hard labels."""
    model = GaussianMixture(k=k, maxIter=max_iter, seed=seed).fit(_features(points))
    centers = [[float(v) for v in g.mean] for g in model.gaussians]
    return Clustering("gaussian_mixture", _labelled(model, points), centers, weights=[float(w) for w in model.weights])


def centers_of(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, n, center) of every cluster but noise."""
    joined = points.join(labels.where(F.col("cluster") >= 0), "id")
    return joined.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("center")
    )


def _with_centers(points: DataFrame, labels: DataFrame, centers: DataFrame) -> DataFrame:
    """Points with their center; centers are broadcast only when they are few."""
    few = centers.limit(MAX_BROADCAST_CENTERS + 1).count() <= MAX_BROADCAST_CENTERS
    return points.join(labels, "id").join(F.broadcast(centers) if few else centers, "cluster")


def cluster_summaries(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, n, center, spread, within): size, mean, mean distance and summed square to the mean.

    Two passes over the points; what comes out has one row per cluster and is written down, as
    the indices below read it several times.
    """
    centers = cut_lineage(centers_of(points, labels))
    squared = array_squared_distance(F.col("vec"), F.col("center"))
    spreads = _with_centers(points, labels, centers).groupBy("cluster").agg(
        F.avg(F.sqrt(squared)).alias("spread"), F.sum(squared).alias("within")
    )
    return cut_lineage(centers.join(spreads, "cluster"))


def davies_bouldin(summaries: DataFrame) -> DataFrame:
    """One row (clusters, davies_bouldin): mean over clusters of the worst (spread + spread) / distance."""
    rows = summaries.select(
        F.col("cluster").cast("long").alias("id"), F.col("center").alias("vec"), "spread", F.lit(0).alias("cell")
    )

    def worst(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        gaps = pairwise(unpack(a["vec"]), unpack(b["vec"]))
        spreads = a["spread"].to_numpy()[:, None] + b["spread"].to_numpy()[None, :]
        apart = gaps > 0
        worst_ratio = np.where(apart, spreads / np.where(apart, gaps, 1.0), 0.0).max(axis=1)
        return pd.DataFrame({"id": a["id"], "r": worst_ratio})

    blocks = blocks_for(rows.count())
    found = block_pairs(rows, rows, (blocks, blocks), worst, "id long, r double")
    return found.groupBy("id").agg(F.max("r").alias("r")).agg(
        F.count(F.lit(1)).alias("clusters"),
        F.when(F.count(F.lit(1)) < 2, F.lit(float("inf"))).otherwise(F.avg("r")).alias("davies_bouldin"),
    )


def calinski_harabasz(summaries: DataFrame) -> DataFrame:
    """One row (clusters, calinski_harabasz): between over within spread, per degree of freedom."""
    overall = summaries.agg(
        vector_to_array(Summarizer.mean(array_to_vector("center"), F.col("n").cast("double")))
    ).first()[0]
    middle = F.array(*[F.lit(v) for v in overall or []]).cast("array<double>")
    sums = summaries.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum("n").alias("n"),
        F.sum("within").alias("within"),
        F.sum(F.col("n") * array_squared_distance(F.col("center"), middle)).alias("between"),
    )
    k, n = F.col("clusters"), F.col("n")
    score = F.try_divide(F.try_divide("between", k - 1), F.try_divide("within", n - k))
    return sums.select(
        "clusters", F.when((k >= 2) & (k < n) & (F.col("within") > 0), score).otherwise(0.0).alias("calinski_harabasz")
    )


def _sums(x: np.ndarray, y: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Per row of `x` the sums of its distances to the rows of `y`, by the columns of `member`."""
    if x.shape[1] > FEW_COLUMNS:
        step = max(1, SUM_CELLS // len(y))
        return np.concatenate([block_distances(x[at : at + step], y) @ member for at in range(0, len(x), step)])
    sums = np.zeros((len(x), member.shape[1]))
    for i in range(0, len(x), TILE[0]):
        for j in range(0, len(y), TILE[1]):
            sums[i : i + TILE[0]] += pairwise(x[i : i + TILE[0]], y[j : j + TILE[1]]) @ member[j : j + TILE[1]]
    return sums


def _distance_sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Per left row and right cluster the sum of the distances."""
    clusters, place = np.unique(b["cluster"].to_numpy(), return_inverse=True)
    sums = _sums(unpack(a["vec"]), unpack(b["vec"]), np.eye(len(clusters))[place])
    return pd.DataFrame(
        {
            "id": np.repeat(a["id"].to_numpy(), len(clusters)),
            "own": np.repeat(a["cluster"].to_numpy(), len(clusters)),
            "other": np.tile(clusters, len(a)),
            "s": sums.ravel(),
        }
    )


def _member_sums(columns: Sequence[tuple[int, int]]):
    """Per left row the sums of its distances to the right rows of each (grouping, cluster)."""

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        theirs = np.array(list(b["own"]))
        member = np.stack([theirs[:, grouping] == cluster for grouping, cluster in columns], axis=1).astype(float)
        return pd.DataFrame({"id": a["id"], "own": a["own"], "s": list(_sums(unpack(a["vec"]), unpack(b["vec"]), member))})

    return work


def _streamed_sums(columns: Sequence[tuple[int, int]]):
    """`_member_sums` of a block of left rows over the pieces of all right rows."""

    def fold(left: pa.Table, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, sums = matrix(left["vec"]), np.zeros((left.num_rows, len(columns)))
        for piece in pieces:
            theirs = matrix(piece.column("own"))
            member = np.stack([theirs[:, grouping] == cluster for grouping, cluster in columns], axis=1).astype(float)
            sums += _sums(x, matrix(piece.column("vec")), member)
        for at in range(0, len(x), PIECE_ROWS):
            part = left.slice(at, PIECE_ROWS)
            mine = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(columns), pa.int32()), pa.array(sums[at : at + PIECE_ROWS].ravel()))
            yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), part["own"].combine_chunks(), mine], names=["id", "own", "s"])

    return fold


def _streamed_means(left: pa.Table, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, a, b): mean distance to a row's own cluster, its row left out, and the least mean to another one.

    Pieces come in the order of their clusters, so sums are held for one unfinished cluster only.
    """
    left = left.sort_by([("id", "ascending"), ("cluster", "ascending")])
    x, ids, own = matrix(left["vec"]), left["id"].to_numpy(zero_copy_only=False), left["cluster"].to_numpy()
    firsts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (own[1:] != own[:-1])])
    ends, names = np.r_[firsts[1:], len(x)], own[firsts]
    a, b, open_sums = np.full(len(firsts), np.nan), np.full(len(firsts), np.inf), np.zeros(len(firsts))
    opened: tuple[int, int] | None = None

    def closed(groups: slice, clusters: np.ndarray, sizes: np.ndarray, sums: np.ndarray) -> None:
        mine = names[groups, None] == clusters[None, :]
        b[groups] = np.minimum(b[groups], np.where(mine, np.inf, sums / sizes).min(axis=1, initial=np.inf))
        rows, columns = np.nonzero(mine & (sizes > 1))
        a[groups.start + rows] = sums[rows, columns] / (sizes[columns] - 1)

    for piece in pieces:
        y, theirs, n = matrix(piece.column("vec")), piece.column("cluster").to_numpy(), piece.column("n").to_numpy()
        starts = np.flatnonzero(np.r_[True, np.diff(theirs) != 0])
        clusters, sizes = theirs[starts], n[starts]
        goes_on = opened is not None and opened[0] == clusters[0]
        if opened is not None and not goes_on:
            closed(slice(0, len(firsts)), np.array([opened[0]]), np.array([opened[1]]), open_sums[:, None])
        step = max(1, SUM_CELLS // len(y))
        for at in range(0, len(firsts), step):
            groups = slice(at, min(at + step, len(firsts)))
            by_row = np.add.reduceat(block_distances(x[firsts[at] : ends[groups.stop - 1]], y), starts, axis=1)
            sums = np.add.reduceat(by_row, firsts[groups] - firsts[at], axis=0)
            if goes_on:
                sums[:, 0] += open_sums[groups]
            open_sums[groups] = sums[:, -1]
            closed(groups, clusters[:-1], sizes[:-1], sums[:, :-1])
        opened = int(clusters[-1]), int(sizes[-1])
    if opened is not None:
        closed(slice(0, len(firsts)), np.array([opened[0]]), np.array([opened[1]]), open_sums[:, None])
    ours = left["id"].combine_chunks().take(pa.array(firsts))
    ways = [pa.array(v, mask=~np.isfinite(v)) for v in (a, b)]
    for at in range(0, len(firsts), BLOCK_ROWS):
        yield pa.RecordBatch.from_arrays([v.slice(at, BLOCK_ROWS) for v in (ours, *ways)], names=["id", "a", "b"])


def _nearest_means(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Per left row its sums of distances to its own cluster and to clusters that other blocks share.

    Of the other clusters, which are whole in the right block, a row hands on the least mean, as that of NOISE.
    """
    a, b = a.sort_values(["id", "cluster"]), b.sort_values("cluster")
    x, y = unpack(a["vec"]), unpack(b["vec"])
    clusters, starts, counts = np.unique(b["cluster"].to_numpy(), return_index=True, return_counts=True)
    sizes = b["n"].to_numpy()[starts]
    whole = counts == sizes
    ids, own = a["id"].to_numpy(), a["cluster"].to_numpy()
    firsts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (own[1:] != own[:-1])])
    step = max(1, SUM_CELLS // len(b))
    out = []
    for at in range(0, len(firsts), step):
        some = firsts[at : at + step]
        stop = firsts[at + step] if at + step < len(firsts) else len(a)
        by_row = np.add.reduceat(block_distances(x[some[0] : stop], y), starts, axis=1)
        sums = np.add.reduceat(by_row, some - some[0], axis=0)
        mine = own[some][:, None] == clusters[None, :]
        judged = whole[None, :] & ~mine
        met = judged.any(axis=1)
        least = np.where(judged, sums / sizes, np.inf).min(axis=1)
        rows, columns = np.nonzero(~judged)
        out.append(pd.DataFrame({"id": ids[some][rows], "own": own[some][rows], "other": clusters[columns], "s": sums[rows, columns]}))
        out.append(pd.DataFrame({"id": ids[some][met], "own": own[some][met], "other": NOISE, "s": least[met]}))
    return pd.concat(out)


def _grouped(points: DataFrame, groupings: Sequence[DataFrame]) -> DataFrame:
    """(id, vec, own): points with their cluster in each grouping, NOISE where one has none for them."""
    marked = [g.where("cluster >= 0").select("id", F.col("cluster").cast("int").alias("cluster")) for g in groupings]
    if len(marked) == 1:
        held = marked[0].select("id", F.array("cluster").alias("own"))
    else:
        together = reduce(DataFrame.unionByName, [m.withColumn("g", F.lit(i)) for i, m in enumerate(marked)])
        chosen = [F.coalesce(F.max(F.when(F.col("g") == i, F.col("cluster"))), F.lit(NOISE)) for i in range(len(marked))]
        held = together.groupBy("id").agg(F.array(*chosen).alias("own"))
    return points.join(held, "id").select("id", "vec", "own")


def _closeness(a, b):
    """The silhouette of mean distances to the own and to the nearest other cluster, negatives set to 0."""
    return F.when(b > a, (b - a) / b).otherwise(0.0)


def _sum_blocks(rows: int, block_rows: int) -> int:
    return max(blocks_for(rows, block_rows), min(SUM_BLOCKS, blocks_for(rows)))


def _cluster_sizes(rows: DataFrame) -> DataFrame:
    found = rows.select(F.posexplode("own").alias("grouping", "cluster")).where("cluster >= 0")
    return found.groupBy("grouping", "cluster").agg(F.count(F.lit(1)).alias("n"))


def _side_by_side_rows(rows: DataFrame, sizes: list, groupings: int, block_rows: int) -> DataFrame:
    """(id, silhouette_0, ...): every distance is taken once for all groupings; null where a row has no silhouette."""
    blocks = _sum_blocks(n := rows.count(), block_rows)
    columns = [(r.grouping, r.cluster) for r in sizes]
    schema = "id long, own array<int>, s array<double>"
    if blocks > PAIRED_BLOCKS:
        held = stream_blocks(rows, n, len(rows.first().vec) + len(columns))
        parts = streamed(rows, rows, held, _streamed_sums(columns), schema, min(PIECE_ROWS, block_rows))
    else:
        dealt = rows.withColumn("cell", F.lit(0))
        parts = block_pairs(dealt, dealt, (blocks, blocks), _member_sums(columns), schema)
    sums = parts.groupBy("id", "own").agg(
        F.count(F.lit(1)).alias("parts"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(len(sizes))]
    )
    means = []
    for g in range(groupings):
        mine = F.col("own")[g]
        items = [(F.lit(r.cluster) == mine, float(r.n), F.col(f"s{i}")) for i, r in enumerate(sizes) if r.grouping == g]
        near = [F.when(same, s / (n - 1)) for same, n, s in items if n > 1]
        far = [F.when(~same, s / n) for same, n, s in items]
        nothing = F.lit(None).cast("double")
        means += [F.array_max(F.array(nothing, *near)).alias(f"a{g}"), F.array_min(F.array(nothing, *far)).alias(f"b{g}")]
    both = sums.select("id", *means).groupBy("id").agg(
        *[f(f"{c}{g}").alias(f"{c}{g}") for g in range(groupings) for f, c in ((F.max, "a"), (F.min, "b"))]
    )
    scores = [
        F.when(F.col(f"a{g}").isNotNull() & F.col(f"b{g}").isNotNull(), _closeness(F.col(f"a{g}"), F.col(f"b{g}"))).alias(f"silhouette_{g}")
        for g in range(groupings)
    ]
    return both.select("id", *scores)


def _many_clusters_rows(rows: DataFrame, block_rows: int) -> DataFrame:
    """(id, silhouette): clusters stay whole in a block, but for those of more than half a block, which are cut.

    A row then hands on, per block, the least mean to another whole cluster, and sums of the few others.
    """
    rows = rows.select("id", "vec", F.col("own")[0].alias("cluster"), F.lit(0).alias("cell"))
    sizes = written(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
    blocks = _sum_blocks(n := rows.count(), block_rows)
    if blocks > PAIRED_BLOCKS:
        left = rows.drop("cell")
        right = left.drop("id").join(sizes, "cluster").repartitionByRange("cluster").sortWithinPartitions("cluster")
        held = stream_blocks(rows, n, len(rows.first().vec) + 8)
        found = streamed(left, right, held, _streamed_means, "id long, a double, b double", min(PIECE_ROWS, block_rows))
        means = found.groupBy("id").agg(F.max("a").alias("a"), F.min("b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
        return means.select("id", _closeness(F.col("a"), F.col("b")).alias("silhouette"))
    half = max(1, block_rows // 2)
    piece = F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.ceil(F.col("n") / half))
    dealt = rows.join(sizes, "cluster").withColumn("piece", F.when(F.col("n") > half, piece).otherwise(0))
    schema = "id long, own int, other int, s double"
    parts = block_pairs(rows, dealt, (blocks, blocks), _nearest_means, schema, together=("cluster", "piece"))
    sums = parts.groupBy("id", "own", "other").agg(F.sum("s").alias("s"), F.min("s").alias("least"))
    known = sums.join(sizes.withColumnRenamed("cluster", "other"), "other", "left")
    mine = F.col("own") == F.col("other")
    a = F.max(F.when(mine & (F.col("n") > 1), F.col("s") / (F.col("n") - 1)))
    b = F.min(F.when(F.col("other") == NOISE, F.col("least")).when(~mine, F.col("s") / F.col("n")))
    means = known.groupBy("id").agg(a.alias("a"), b.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return means.select("id", _closeness(F.col("a"), F.col("b")).alias("silhouette"))


def silhouette_rows(points: DataFrame, labels: DataFrame, block_rows: int = SUM_ROWS) -> DataFrame:
    """(id, silhouette) of every clustered row that is not alone, with negatives set to 0.

    Up to PAIRED_BLOCKS blocks a side, each pair of row blocks is one group that hands on sums per cluster, never
    pairs. Beyond, a block of rows stays in one task, and all rows come to it packed and in pieces, so that only the sums over
    all rows are handed on. With more than MAX_SUMS clusters least means go out instead of sums. The
    arithmetic is still quadratic: use `silhouette_sampled` or `silhouette_squared` on large tables.
    """
    rows = written(_grouped(points, [labels]))
    sizes = _cluster_sizes(rows).limit(MAX_SUMS + 1).collect()
    if len(sizes) > MAX_SUMS:
        return _many_clusters_rows(rows, block_rows)
    found = _side_by_side_rows(rows, sizes, 1, block_rows)
    return found.where("silhouette_0 IS NOT NULL").withColumnRenamed("silhouette_0", "silhouette")


def silhouette_means(points: DataFrame, groupings: Sequence[DataFrame], block_rows: int = SUM_ROWS) -> list[float]:
    """The mean of `silhouette_rows` for each of several groupings of the same points.

    Distances are taken once for all, where ids are unique and the clusters at most MAX_SUMS.
    """
    n, kinds = points.agg(F.count(F.lit(1)), F.countDistinct("id")).first()
    if groupings and n == kinds:
        rows = written(_grouped(points, groupings))
        sizes = _cluster_sizes(rows).limit(MAX_SUMS + 1).collect()
        if len(sizes) <= MAX_SUMS:
            found = _side_by_side_rows(rows, sizes, len(groupings), block_rows)
            means = [F.coalesce(F.avg(f"silhouette_{g}"), F.lit(0.0)) for g in range(len(groupings))]
            return [float(v) for v in found.agg(*means).first()]
    return [float(silhouette(points, labels).first().silhouette) for labels in groupings]


def silhouette(points: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the mean of `silhouette_rows`, 0 when there are none."""
    return silhouette_rows(points, labels).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("silhouette")
    )


def silhouette_sampled_rows(
    points: DataFrame,
    labels: DataFrame,
    per_cluster: int = SAMPLE_PER_CLUSTER,
    miss: float = 0.001,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, silhouette, low, high) of every clustered row that is not alone, in time linear in the rows.

    Mean distances are taken to `per_cluster` (2 or more) rows of each cluster, those with the smallest
    md5 of the id; all rows are judged. `low` and `high` hold the exact value but for a share `miss` of
    such samples: no distance to a cluster differs from another by more than twice its radius, which
    bounds how far the mean of a sample without replacement strays (Hoeffding's bound with Serfling's
    factor, shared out over the clusters). Clusters of at most `per_cluster` rows are exact.
    """
    rows = points.join(labels.where("cluster >= 0"), "id").select(
        "id", "vec", F.col("cluster").cast("int").alias("cluster"), F.lit(0).alias("cell")
    )
    draw = F.struct(F.md5(F.col("id").cast("string")).alias("draw"), F.col("id").alias("id"))
    # the rank limit also holds within each task before the shuffle, so a large cluster sends few rows
    first = Window.partitionBy("cluster").orderBy("drawn")
    picked = rows.withColumn("drawn", draw).withColumn("place", F.row_number().over(first))
    sample = written(picked.where(F.col("place") <= per_cluster).drop("place"))
    squared = array_squared_distance(F.col("vec"), F.col("center"))
    placed = _with_centers(points, labels, cut_lineage(centers_of(points, labels)))
    radii = placed.groupBy(F.col("cluster").cast("int").alias("other")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.sqrt(squared)).alias("radius")
    )
    ends = sample.groupBy(F.col("cluster").alias("other")).agg(F.count(F.lit(1)).alias("m"), F.max("drawn").alias("last"))
    sizes = written(radii.join(ends, "other"))
    k = max(1, sizes.count())
    blocks = (blocks_for(rows.count(), block_rows), blocks_for(sample.count(), block_rows))
    parts = block_pairs(rows, sample.drop("drawn"), blocks, _distance_sums, "id long, own int, other int, s double")
    sums = parts.groupBy("id", "own", "other").agg(F.sum("s").alias("s")).join(sizes, "other")
    mine = F.col("own") == F.col("other")
    size = F.col("n") - mine.cast("long")
    taken = F.col("m") - (mine & (draw <= F.col("last"))).cast("long")
    left_out = 1 - (F.col("taken") - 1) / F.col("size")
    margin = 2 * F.col("radius") * F.sqrt(left_out * math.log(2 * k / miss) / (2 * F.col("taken")))
    means = (
        sums.withColumns({"size": size, "taken": taken, "mine": mine})
        .where("size > 0 AND taken > 0")
        .withColumn("mean", F.col("s") / F.col("taken"))
        .withColumn("margin", F.when(F.col("taken") >= F.col("size"), 0.0).otherwise(margin))
    )
    near, far = F.greatest(F.col("mean") - F.col("margin"), F.lit(0.0)), F.col("mean") + F.col("margin")
    own = [F.max(F.when(F.col("mine"), x)).alias(f"a{i}") for i, x in enumerate((F.col("mean"), near, far))]
    other = [F.min(F.when(~F.col("mine"), x)).alias(f"b{i}") for i, x in enumerate((F.col("mean"), near, far))]
    found = means.groupBy("id").agg(*own, *other).where("a0 IS NOT NULL AND b0 IS NOT NULL")
    return found.select(
        "id",
        _closeness(F.col("a0"), F.col("b0")).alias("silhouette"),
        _closeness(F.col("a2"), F.col("b1")).alias("low"),
        _closeness(F.col("a1"), F.col("b2")).alias("high"),
    )


def silhouette_sampled(points: DataFrame, labels: DataFrame, per_cluster: int = SAMPLE_PER_CLUSTER) -> DataFrame:
    """One row (n, silhouette_sampled, low, high): means of `silhouette_sampled_rows`, 0 when there are none."""
    means = [("silhouette", "silhouette_sampled"), ("low", "low"), ("high", "high")]
    return silhouette_sampled_rows(points, labels, per_cluster).agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for c, name in means]
    )


def silhouette_squared(points: DataFrame, labels: DataFrame) -> float:
    """Silhouette on squared distances, one linear scan; not the same number as `silhouette`."""
    rows = _features(points).join(labels.where("cluster >= 0").withColumnRenamed("cluster", "prediction"), "id")
    if rows.select("prediction").distinct().limit(2).count() < 2:
        return 0.0
    return float(ClusteringEvaluator().evaluate(rows.withColumn("prediction", F.col("prediction").cast("int"))))


def cluster_metrics(
    points: DataFrame, labels: DataFrame, measure: str = "silhouette", score: float | None = None
) -> dict[str, float]:
    """The chosen one of `MEASURES` under its own name, Davies-Bouldin and Calinski-Harabasz of a grouping.

    The measure never depends on the table's size: a caller with too many rows for the exact one
    asks for another one and gets it under its name. A caller that has measured it already gives it as `score`.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    if score is not None:
        pass
    elif measure == "silhouette_squared":
        score = silhouette_squared(points, labels)
    else:
        score = (silhouette if measure == "silhouette" else silhouette_sampled)(points, labels).first()[measure]
    summaries = cluster_summaries(points, labels)
    return {
        measure: float(score),
        "davies_bouldin": float(davies_bouldin(summaries).first().davies_bouldin),
        "calinski_harabasz": float(calinski_harabasz(summaries).first().calinski_harabasz),
    }


def find_k(points: DataFrame, most: int = 10, measure: str = "silhouette") -> tuple[DataFrame, int]:
    """(one row per k with its metrics, best k by `measure`) for K-Means with 2 to `most` clusters.

    The exact silhouettes of all k come from one pass over the distances.
    """
    n = points.count()
    ensure_checkpoint_dir(points.sparkSession)

    def grouped(k):
        found = kmeans(points, k)
        return k, found.inertia, cut_lineage(found.labels)

    found = side_by_side(grouped, range(2, min(most, n - 1) + 1))
    every = [labels for _, _, labels in found]
    scores = silhouette_means(points, every) if measure == "silhouette" else [None] * len(every)

    def measured(one):
        (k, inertia, labels), score = one
        return {"k": k, "inertia": inertia, **cluster_metrics(points, labels, measure, score)}

    rows = side_by_side(measured, zip(found, scores, strict=True))
    best = max(rows, key=lambda r: (r[measure], -r["k"]))["k"] if rows else 2
    schema = f"k int, inertia double, {measure} double, davies_bouldin double, calinski_harabasz double"
    return points.sparkSession.createDataFrame(rows, schema), best


def covariance(points: DataFrame) -> DataFrame:
    """Long matrix (i, j, value) of X'X / (n - 1) for points that are already centred."""
    width = len(points.first().vec)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = [F.sum(F.col("vec")[i] * F.col("vec")[j]).alias(f"s{i}_{j}") for i, j in pairs]
    bottom = F.greatest(F.col("n") - 1, F.lit(1))
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(f"s{i}_{j}") / bottom).alias("value")) for i, j in pairs]
    return points.agg(F.count(F.lit(1)).alias("n"), *sums).select(F.inline(F.array(*cells)))


def min_points(columns: int) -> int:
    """Neighbours that make a core point, by the number of columns."""
    return max(3, min(5, math.floor(1.5 * columns)))


def core_points(points: DataFrame, min_pts: int, eps: float | None = None) -> tuple[DataFrame, float]:
    """((id, core), eps): a row with `min_pts` rows within eps, itself counted.

    Without eps it is the value at rank floor(.85 n) of the distances to the min_pts-th neighbour.
    """
    n = points.count()
    near = cut_lineage(nearest(points, points, min(min_pts, n - 1), same=True))
    if eps is None:
        far = near.groupBy("id").agg(F.max("distance").alias("far"))
        eps = order_stats(far, {"far": (0.85,)})["far"][0.85] or 1.0
    needed = near.where((F.col("rank") == min_pts - 1) & (F.col("distance") <= eps)).select("id")
    marked = points.select("id").join(needed.withColumn("core", F.lit(True)), "id", "left")
    return marked.select("id", F.coalesce("core", F.lit(False)).alias("core")), eps


GRID_COLUMNS = 3
LOCAL_EDGES = 200_000
SENT_EDGES = 20_000
CELL_ROWS = 300


def _cells(points: DataFrame, eps: float) -> DataFrame:
    """Grid cell over the first three columns, of side eps or wider where rows are sparse.

    Any side from eps up lets a row reach only its own and the next cells; a wider one saves
    groups that would hold a handful of rows.
    """
    width = min(GRID_COLUMNS, len(points.first().vec))
    x = [F.col("vec")[i] for i in range(width)]
    n, *ends = points.agg(F.count(F.lit(1)), *[f(c) for c in x for f in (F.min, F.max)]).first()
    spans = [max(ends[2 * i + 1] - ends[2 * i], eps) for i in range(width)]
    side = max(eps, (math.prod(spans) * CELL_ROWS / n) ** (1 / width))
    return points.withColumn("_c", F.array(*[F.floor(c / F.lit(side)).cast("long") for c in x]))


def _around(cells: DataFrame) -> DataFrame:
    """Rows repeated for their own and every neighbouring cell."""
    width = len(cells.first()._c)
    shifts = F.array(*[F.array(*[F.lit(s).cast("long") for s in shift]) for shift in product((-1, 0, 1), repeat=width)])
    return cells.withColumn("_s", F.explode(shifts)).withColumn("cell", F.zip_with("_c", "_s", lambda a, b: a + b))


def _links(eps: float):
    """A few edges (id, to) that connect all rows of two blocks that reach each other within eps."""

    def links(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        close = pairwise(unpack(a["vec"]), unpack(b["vec"])) <= eps
        left, right = a["id"].to_numpy(), b["id"].to_numpy()
        mine = left.copy()
        big = np.iinfo(np.int64).max
        while True:
            theirs = np.where(close, mine[:, None], big).min(axis=0)
            theirs = np.minimum(theirs, np.where(theirs < big, right, big))
            new = np.minimum(mine, np.where(close, theirs[None, :], big).min(axis=1))
            if (new == mine).all():
                break
            mine = new
        joined = theirs < big
        out = pd.DataFrame(
            {"id": np.concatenate([left, right[joined]]), "to": np.concatenate([mine, theirs[joined]])}
        )
        return out[out["id"] != out["to"]].drop_duplicates()

    return links


def _joined_up(frames):
    """(id, component) of the ends of all edges, by one pass of union and find."""
    parent: dict = {}

    def root(node):
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    for frame in frames:
        for a, b in zip(frame["id"].tolist(), frame["to"].tolist(), strict=True):
            a, b = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": list(parent), "component": [root(node) for node in parent]})


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id each node is connected to.

    Rounds of hooking on the smallest neighbour and then jumping to the hook's hook, so the number
    of rounds grows with the logarithm of the longest chain. Each round is written to the
    checkpoint folder, and the rounds stop when nothing changes. Edges that were counted to be few
    (`LOCAL_EDGES`) are joined up by one task instead, with the same result.
    """
    both = edges.select("id", "to").unionByName(edges.select(F.col("to").alias("id"), F.col("id").alias("to")))
    both = written(both.where("id <> to").distinct())
    if (found := both.count()) <= LOCAL_EDGES:
        met = both.where("id < to").coalesce(1).mapInPandas(_joined_up, both.select("id", F.col("to").alias("component")).schema)
        return nodes.join(met.hint("merge") if found > SENT_EDGES else met, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    state = written(nodes.select("id", F.col("id").alias("component")))
    while True:
        across = both.join(state.select(F.col("id").alias("to"), "component").hint("merge"), "to").select("id", "component")
        lowest = across.groupBy("id").agg(F.min("component").alias("low"))
        hooked = state.join(lowest.hint("merge"), "id", "left").select(
            "id", "component", F.least("component", F.coalesce("low", "component")).alias("hook")
        )
        # what a component's members found is also news for the component's first node
        news = hooked.groupBy(F.col("component").alias("root")).agg(F.min("hook").alias("best"))
        next_state = hooked.join(news.hint("merge"), F.col("component") == F.col("root")).select(
            "id", F.col("component").alias("before"), F.least("hook", "best").alias("hook")
        )
        target = next_state.select(F.col("id").alias("root"), F.col("hook").alias("jump"))
        moved = next_state.join(target.hint("merge"), F.col("hook") == F.col("root")).select(
            "id", "before", F.least("hook", "jump").alias("component")
        )
        moved = written(moved)
        changed = moved.where("before <> component").limit(1).count()
        state = moved.select("id", "component")
        if not changed:
            return state


def dbscan(points: DataFrame, min_pts: int, eps: float | None = None, block_rows: int = BLOCK_ROWS) -> Clustering:
    """Density clusters: chains of core points within eps, borders with the lowest cluster that reaches them.

    Candidates come from equal grid cells of side eps and are checked by their exact distance.
    Copies of a vector are folded first: they share cell, core mark and cluster. Blocks hand on
    connecting edges, at most two per row, never their pairs.
    """
    flags, eps = core_points(points, min_pts, eps)
    marked = points.select("id", "vec").join(flags, "id")
    kinds = marked.groupBy("vec").agg(F.min("id").alias("id"), F.max("core").alias("core"))
    kinds = cut_lineage(_cells(kinds, eps))
    home = kinds.withColumn("cell", F.col("_c"))
    core = home.where("core").select("id", "vec", "cell")
    reach = _around(kinds.where("core")).select("id", "vec", "cell")
    forward = block_pairs(core, reach, block_sizes(core, reach, block_rows), _links(eps), "id long, to long")
    parts = connected(core, forward)
    places = numbered(parts.select("component").distinct(), [("component", True)], name="place")
    first = places.select("component", (F.col("place") - 1).cast("int").alias("cluster"))
    cores = cut_lineage(parts.join(first, "component").select("id", "cluster"))
    border = home.where("NOT core").select("id", "vec", "cell")
    labelled = reach.join(cores, "id")

    def lowest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        close = pairwise(unpack(a["vec"]), unpack(b["vec"])) <= eps
        big = np.iinfo(np.int32).max
        found = np.where(close, b["cluster"].to_numpy()[None, :], big).min(axis=1)
        return pd.DataFrame({"id": a["id"], "cluster": found})[found < big]

    reached = block_pairs(border, labelled, block_sizes(border, labelled, block_rows), lowest, "id long, cluster int")
    edge = reached.groupBy("id").agg(F.min("cluster").alias("cluster"))
    of_kind = cores.unionByName(edge)
    labels = (
        kinds.select("vec", "id")
        .join(of_kind, "id", "left")
        .select("vec", F.coalesce("cluster", F.lit(NOISE)).cast("int").alias("cluster"))
        .join(points.select("id", "vec"), "vec")
        .select("id", "cluster")
    )
    labels = cut_lineage(labels)
    return Clustering("dbscan", labels, centers_of(points, labels))


def cluster_means(df: DataFrame, labels: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(cluster, size, means) with an overall row whose cluster is NULL, noise left out."""
    rows = df.join(labels.withColumnRenamed("id", key).where("cluster >= 0"), key)
    means = [F.avg(quoted(c)).alias(f"mean_{c}") for c in columns]
    per = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *means)
    whole = rows.agg(F.count(F.lit(1)).alias("size"), *means).withColumn("cluster", F.lit(None).cast("int"))
    return per.unionByName(whole)


def read_clusters(df: DataFrame, labels: DataFrame, key: str, columns: Sequence[str], top: int = 3, notable: float = 5) -> DataFrame:
    """(cluster, size, feature, cluster_mean, overall_mean, deviation, direction, notable): three per cluster."""
    means = cluster_means(df, labels, key, columns)
    items = [F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean")) for c in columns]
    long = means.select("cluster", "size", F.inline(F.array(*items)))
    overall = long.where("cluster IS NULL").select("feature", F.col("mean").alias("overall_mean"))
    both = long.where("cluster IS NOT NULL").withColumnRenamed("mean", "cluster_mean").join(F.broadcast(overall), "feature")
    gap = F.col("cluster_mean") - F.col("overall_mean")
    both = both.withColumns(
        {
            "deviation": ratio(gap, F.abs("overall_mean")) * 100,
            "direction": F.when(gap > 0, "higher").otherwise("lower"),
        }
    ).withColumn("notable", F.abs("deviation") > notable)
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.abs("deviation")), "feature"))
    return both.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")


def assign(points: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """(id, cluster, distance): the nearest center of each point, the first on a tie."""
    matrix = np.array(centers, dtype=float)

    def nearest_center(frames):
        for frame in frames:
            gaps = pairwise(unpack(frame["vec"]), matrix)
            chosen = gaps.argmin(axis=1)
            yield pd.DataFrame(
                {"id": frame["id"], "cluster": chosen.astype("int32"), "distance": gaps[np.arange(len(frame)), chosen]}
            )

    return points.select("id", "vec").mapInPandas(nearest_center, "id long, cluster int, distance double")


def cluster_with(method: Callable[..., Clustering], points: DataFrame, **options) -> Clustering:
    """Group points with the method the caller brings."""
    return method(points, **options)
