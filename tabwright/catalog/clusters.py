"""Grouping, cluster quality, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.anomalies import standard_points
from tabwright.catalog.base import query, spread_table, sql_order_stat, table
from tabwright.catalog.learning import SQL_DISTANCE, embedded
from tabwright.catalog.profiling import rounded
from tabwright.operators import cluster as K
from tabwright.operators.projection import pca, pca_sparse
from tabwright.operators.text import tfidf
from tabwright.session import cut_lineage

ORDER_COLUMNS = ["o_totalprice", "day"]


def order_points(spark, folder):
    df = spread_table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("day")
    )
    return standard_points(df, "o_orderkey", ORDER_COLUMNS)


def vectors(spark, folder):
    """Embeddings as points and their given label as the cluster."""
    df = embedded(spark, folder)
    return df.select("id", "vec"), df.select("id", F.col("label").alias("cluster"))


_centers = """
    WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM e GROUP BY 1, 2),
    d AS (SELECT vec_id, label, sum((v - m) ** 2) AS q FROM e JOIN c USING (label, i) GROUP BY 1, 2)
"""


@query(
    "davies_bouldin_embeddings", "UNS-8", "FUN-5",
    sql=_centers
    + """, s AS (SELECT label, avg(sqrt(q)) AS spread FROM d GROUP BY 1),
    p AS (SELECT a.label AS x, b.label AS y, sqrt(sum((a.m - b.m) ** 2)) AS gap FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
    r AS (SELECT x, max(CASE WHEN gap > 0 THEN (s1.spread + s2.spread) / gap ELSE 0 END) AS r
      FROM p JOIN s s1 ON s1.label = x JOIN s s2 ON s2.label = y GROUP BY 1)
    SELECT count(*) AS clusters, round(avg(r), 6) AS davies_bouldin FROM r""",
)
def davies_bouldin_embeddings(spark, folder):
    return rounded(K.davies_bouldin(K.cluster_summaries(*vectors(spark, folder))), "davies_bouldin")


@query(
    "calinski_harabasz_embeddings", "UNS-9",
    sql=_centers
    + """, o AS (SELECT i, avg(v) AS o FROM e GROUP BY 1), b AS (SELECT sum(n * (m - o) ** 2) AS bss FROM c JOIN o USING (i)),
    w AS (SELECT sum(q) AS wss, count(*) AS n, count(DISTINCT label) AS k FROM d)
    SELECT k AS clusters, round((bss / (k - 1)) / (wss / (n - k)), 5) AS calinski_harabasz FROM b, w""",
)
def calinski_harabasz_embeddings(spark, folder):
    return rounded(K.calinski_harabasz(K.cluster_summaries(*vectors(spark, folder))), "calinski_harabasz", places=5)


_silhouette = f"""
    WITH d AS (SELECT a.vec_id AS id, a.label AS own, b.label AS other, {SQL_DISTANCE} AS distance
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    g AS (SELECT id, own, other, avg(distance) AS d FROM d GROUP BY 1, 2, 3),
    s AS (SELECT id, max(CASE WHEN own = other THEN d END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM g GROUP BY 1),
    r AS (SELECT id, CASE WHEN b > a THEN (b - a) / b ELSE 0 END AS s FROM s WHERE a IS NOT NULL AND b IS NOT NULL)
"""


@query("silhouette_embeddings", "UNS-7", "JOI-6", sql=_silhouette + "SELECT count(*) AS n, round(avg(s), 6) AS silhouette FROM r")
def silhouette_embeddings(spark, folder):
    return rounded(K.silhouette(*vectors(spark, folder)), "silhouette")


@query("silhouette_per_row", "UNS-7", sql=_silhouette + "SELECT id, round(s, 6) AS silhouette FROM r")
def silhouette_per_row(spark, folder):
    return rounded(K.silhouette_rows(*vectors(spark, folder)), "silhouette")


@query(
    "silhouette_sampled_embeddings", "UNS-7", "FEA-9",
    sql=f"""
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS place FROM embeddings),
    e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM e GROUP BY 1, 2),
    q AS (SELECT vec_id, label, n, sqrt(sum((v - m) ** 2)) AS d FROM e JOIN c USING (label, i) GROUP BY 1, 2, 3),
    z AS (SELECT label AS other, n, max(d) AS radius, count(*) OVER () AS k FROM q GROUP BY 1, 2),
    s AS (SELECT a.vec_id AS id, a.label = b.label AS mine, b.label AS other, count(*) - count_if(a.vec_id = b.vec_id) AS taken,
        sum({SQL_DISTANCE}) AS s
      FROM embeddings a JOIN (SELECT * FROM p WHERE place <= 24) b ON true GROUP BY 1, 2, 3),
    g AS (SELECT id, mine, taken, k, radius, s / taken AS mean, n - mine::INT AS size FROM s JOIN z USING (other) WHERE taken > 0),
    t AS (SELECT *, CASE WHEN taken >= size THEN 0
        ELSE 2 * radius * sqrt((1 - (taken - 1) / size) * ln(2 * k / 0.001) / (2 * taken)) END AS margin FROM g),
    r AS (SELECT id, max(CASE WHEN mine THEN mean END) AS a0, max(CASE WHEN mine THEN greatest(mean - margin, 0) END) AS a1,
        max(CASE WHEN mine THEN mean + margin END) AS a2, min(CASE WHEN NOT mine THEN mean END) AS b0,
        min(CASE WHEN NOT mine THEN greatest(mean - margin, 0) END) AS b1, min(CASE WHEN NOT mine THEN mean + margin END) AS b2
      FROM t GROUP BY 1)
    SELECT id, round(CASE WHEN b0 > a0 THEN (b0 - a0) / b0 ELSE 0 END, 6) AS silhouette,
      round(CASE WHEN b1 > a2 THEN (b1 - a2) / b1 ELSE 0 END, 6) AS low,
      round(CASE WHEN b2 > a1 THEN (b2 - a1) / b2 ELSE 0 END, 6) AS high
    FROM r WHERE a0 IS NOT NULL AND b0 IS NOT NULL
    """,
)
def silhouette_sampled_embeddings(spark, folder):
    return rounded(K.silhouette_sampled_rows(*vectors(spark, folder), per_cluster=24), "silhouette", "low", "high")


@query(
    "silhouette_squared_embeddings", "UNS-7",
    sql="""
    WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    q AS (SELECT vec_id, label, sum(v * v) AS q FROM e GROUP BY 1, 2),
    c AS (SELECT label AS other, i, avg(v) AS m FROM e GROUP BY 1, 2),
    k AS (SELECT label AS other, count(*) AS n, avg(q) AS p FROM q GROUP BY 1),
    d AS (SELECT vec_id, label, other, sum(v * m) AS d FROM e JOIN c USING (i) GROUP BY 1, 2, 3),
    g AS (SELECT vec_id, label, other, n, q.q + p - 2 * d AS gap FROM d JOIN q USING (vec_id, label) JOIN k USING (other)),
    s AS (SELECT vec_id, max(CASE WHEN label = other THEN n END) AS n, max(CASE WHEN label = other THEN gap * n / nullif(n - 1, 0) END) AS a,
      min(CASE WHEN label <> other THEN gap END) AS b FROM g GROUP BY 1)
    SELECT round(avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette_squared FROM s
    """,
)
def silhouette_squared_embeddings(spark, folder):
    found = spark.createDataFrame([(K.silhouette_squared(*vectors(spark, folder)),)], "silhouette_squared double")
    return rounded(found, "silhouette_squared")


@query(
    "nearest_centroid", "UNS-11", "JOI-7",
    sql=_centers
    + """, x AS (SELECT e.vec_id AS id, c.label, sum((v - m) ** 2) AS q FROM e JOIN c ON c.i = e.i GROUP BY 1, 2)
    SELECT id, arg_min(label, q) AS cluster, round(sqrt(min(q)), 6) AS distance FROM x GROUP BY 1""",
)
def nearest_centroid(spark, folder):
    points, labels = vectors(spark, folder)
    centers = [list(r.center) for r in K.centers_of(points, labels).orderBy("cluster").collect()]
    return rounded(K.assign(points, centers), "distance")


_segments = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 3 END"


def segments(spark, folder):
    df = table(spark, folder, "customer")
    word = F.col("c_mktsegment")
    cluster = F.when(word == "AUTOMOBILE", 0).when(word == "BUILDING", 1).when(word == "FURNITURE", 2).otherwise(3)
    return df, df.select(F.col("c_custkey").alias("id"), cluster.alias("cluster"))


@query(
    "cluster_means_customer", "AGG-9",
    sql=f"""
    SELECT {_segments} AS cluster, count(*) AS size, round(avg(c_acctbal), 5) AS mean_c_acctbal, round(avg(c_nationkey), 5) AS mean_c_nationkey FROM customer GROUP BY 1
    UNION ALL SELECT NULL, count(*), round(avg(c_acctbal), 5), round(avg(c_nationkey), 5) FROM customer
    """,
)
def cluster_means_customer(spark, folder):
    out = K.cluster_means(*segments(spark, folder), "c_custkey", ["c_acctbal", "c_nationkey"])
    return rounded(out, "mean_c_acctbal", "mean_c_nationkey", places=5)


_read = ("c_acctbal", "c_nationkey", "c_custkey")


@query(
    "read_clusters_customer", "UNS-10",
    sql=f"""
    WITH m AS ({" UNION ALL ".join(f"SELECT {_segments} AS cluster, count(*) AS size, '{c}' AS feature, avg({c}) AS cm, (SELECT avg({c}) FROM customer) AS om FROM customer GROUP BY 1" for c in _read)})
    SELECT cluster, size, feature, round(cm, 5) AS cluster_mean, round(om, 5) AS overall_mean, round((cm - om) / abs(om) * 100, 4) AS deviation,
      CASE WHEN cm > om THEN 'higher' ELSE 'lower' END AS direction, abs((cm - om) / om) * 100 > 5 AS notable FROM m
    """,
)
def read_clusters_customer(spark, folder):
    df, labels = segments(spark, folder)
    df = df.withColumn("c_key", F.col("c_custkey"))
    out = K.read_clusters(df.drop("c_custkey"), labels, "c_key", ["c_acctbal", "c_nationkey"]).unionByName(
        K.read_clusters(df, labels, "c_key", ["c_custkey"])
    )
    return rounded(rounded(out, "cluster_mean", "overall_mean", places=5), "deviation", places=4)


@query(
    "covariance_orders", "UNS-6",
    sql="""
    WITH m AS (SELECT avg(o_totalprice) AS a1, stddev_pop(o_totalprice) AS s1, avg(datediff('day', DATE '1970-01-01', o_orderdate)) AS a2,
        stddev_pop(datediff('day', DATE '1970-01-01', o_orderdate)) AS s2 FROM orders),
    z AS (SELECT (o_totalprice - a1) / s1 AS x, (datediff('day', DATE '1970-01-01', o_orderdate) - a2) / s2 AS y FROM orders, m)
    SELECT 0 AS i, 0 AS j, round(sum(x * x) / (count(*) - 1), 6) AS value FROM z UNION ALL
    SELECT 0, 1, round(sum(x * y) / (count(*) - 1), 6) FROM z UNION ALL SELECT 1, 1, round(sum(y * y) / (count(*) - 1), 6) FROM z
    """,
)
def covariance_orders(spark, folder):
    return rounded(K.covariance(order_points(spark, folder)), "value")


@query("pca_embeddings", "UNS-6")
def pca_embeddings(spark, folder):
    scores, shares = pca(vectors(spark, folder)[0])
    return scores.withColumns({f"share_{i + 1}": F.lit(v) for i, v in enumerate(shares)})


@query(
    "pca_orders", "UNS-6",
    sql="""
    WITH m AS (SELECT avg(o_totalprice) AS a1, stddev_pop(o_totalprice) AS s1, avg(datediff('day', DATE '1970-01-01', o_orderdate)) AS a2,
        stddev_pop(datediff('day', DATE '1970-01-01', o_orderdate)) AS s2 FROM orders),
    z AS (SELECT o_orderkey, (o_totalprice - a1) / s1 AS x, (datediff('day', DATE '1970-01-01', o_orderdate) - a2) / s2 AS y FROM orders, m),
    r AS (SELECT sum(x * y) / count(*) AS r, CASE WHEN sum(x * y) > 0 THEN 1.0 ELSE -1.0 END AS side FROM z)
    SELECT o_orderkey AS id, round((x + side * y) / sqrt(2), 6) AS pc1, round((x - side * y) / sqrt(2), 6) AS pc2,
      round((1 + abs(r)) / 2, 9) AS share_1, round((1 - abs(r)) / 2, 9) AS share_2 FROM z, r
    """,
)
def pca_orders(spark, folder):
    """Two standardised columns: the components are their sum and their difference."""
    scores, shares = pca(order_points(spark, folder))
    out = scores.withColumns({f"share_{i + 1}": F.round(F.lit(v), 9) for i, v in enumerate(shares)})
    return rounded(out, "pc1", "pc2")


@query("pca_terms", "UNS-6")
def pca_terms(spark, folder):
    """Documents by 5,000 term weights, projected to two components."""
    documents = spread_table(spark, folder, "documents").select("doc_id", "text")
    weights = cut_lineage(tfidf(documents, "doc_id", "text", max_terms=5_000))
    terms = sorted(r.term for r in weights.select("term").distinct().collect())
    places = spark.createDataFrame(list(enumerate(terms)), "place int, term string")
    entries = weights.join(F.broadcast(places), "term")
    rows = entries.groupBy(F.col("doc_id").alias("id")).agg(
        F.collect_list("place").alias("indices"), F.collect_list("weight").alias("values")
    )
    scores, shares = pca_sparse(cut_lineage(rows), len(terms))
    return scores.withColumns({f"share_{i + 1}": F.lit(v) for i, v in enumerate(shares)})


@query("kmeans_orders", "UNS-1", "UDF-3")
def kmeans_orders(spark, folder):
    found = K.cluster_with(K.kmeans, order_points(spark, folder), k=4)
    return found.labels.withColumn("inertia", F.lit(found.inertia))


@query("hierarchical_orders", "UNS-3")
def hierarchical_orders(spark, folder):
    return K.hierarchical(order_points(spark, folder), 4).labels


@query("gaussian_mixture_orders", "UNS-5")
def gaussian_mixture_orders(spark, folder):
    return K.gaussian_mixture(order_points(spark, folder), 3).labels


@query("find_k_embeddings", "UNS-2")
def find_k_embeddings(spark, folder):
    return K.find_k(vectors(spark, folder)[0])[0]


_part_points = """
    WITH m AS (SELECT avg(p_size) AS a1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS a2, stddev_pop(p_retailprice) AS s2 FROM part),
    z AS (SELECT p_partkey AS id, (p_size - a1) / s1 AS x, (p_retailprice - a2) / s2 AS y FROM part, m),
    d AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM z a JOIN z b ON a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance) AS rank FROM d),
    k AS (SELECT id, distance AS far FROM r WHERE rank = 3)
"""


@query(
    "dbscan_core_points", "UNS-4",
    sql=_part_points
    + f""", e AS (SELECT {sql_order_stat('far', 0.85)} AS eps FROM k),
    c AS (SELECT d.id, count(*) FILTER (WHERE distance <= eps) + 1 AS near FROM d, e GROUP BY 1)
    SELECT id, near >= 3 AS core, round((SELECT eps FROM e), 6) AS eps FROM c""",
)
def dbscan_core_points(spark, folder):
    flags, eps = K.core_points(part_points(spark, folder), 3)
    return flags.withColumn("eps", F.round(F.lit(eps), 6))


def part_points(spark, folder):
    return standard_points(table(spark, folder, "part"), "p_partkey", ["p_size", "p_retailprice"])


@query(
    "dbscan_part", "UNS-4",
    sql=_part_points.replace("WITH m AS", "WITH RECURSIVE m AS")
    + f""", e AS (SELECT {sql_order_stat('far', 0.85)} AS eps FROM k),
    near AS (SELECT d.id, d.other FROM d, e WHERE distance <= eps),
    core AS (SELECT id FROM near GROUP BY id HAVING count(*) + 1 >= 3),
    links AS (SELECT n.id, n.other FROM near n JOIN core a ON a.id = n.id JOIN core b ON b.id = n.other),
    parts(id, root) USING KEY (id) AS (
      SELECT id, id FROM core
      UNION
      SELECT l.id, min(p.root) FROM parts p JOIN links l ON l.other = p.id JOIN recurring.parts r ON r.id = l.id
      WHERE p.root < r.root GROUP BY l.id),
    numbers AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM parts),
    border AS (SELECT n.id, min(c.cluster) AS cluster FROM near n JOIN numbers c ON c.id = n.other WHERE n.id NOT IN (SELECT id FROM core) GROUP BY n.id)
    SELECT z.id, coalesce(c.cluster, b.cluster, -1)::INTEGER AS cluster FROM z LEFT JOIN numbers c ON c.id = z.id LEFT JOIN border b ON b.id = z.id""",
)
def dbscan_part(spark, folder):
    return K.dbscan(part_points(spark, folder), K.min_points(2)).labels
