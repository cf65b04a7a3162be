"""Column choice, encodings, text weights and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, spread_table, table
from tabwright.catalog.profiling import rounded
from tabwright.functions import sampling
from tabwright.operators import features as X
from tabwright.operators import text as T


@query("select_features_part", "PRJ-1", sql="SELECT p_size, p_type, p_retailprice FROM part")
def select_features_part(spark, folder):
    return X.select_features(table(spark, folder, "part"), "p_retailprice", ["p_size", "p_type"])


@query("exclude_columns_part", "PRJ-2", sql="SELECT p_partkey, p_type, p_size, p_retailprice FROM part")
def exclude_columns_part(spark, folder):
    return X.exclude(table(spark, folder, "part"), ["p_name", "p_brand"])


_leak_columns = ["l_orderkey", "l_quantity", "l_shipdate", "l_returnflag", "paid", "row_id"]


@query(
    "leakage_columns", "PRJ-3",
    sql=" UNION ALL ".join(
        f"SELECT '{c}' AS name, regexp_matches('{c}', 'id|date|year|added|created|updated') AS dropped, count({c}) AS n_present "
        "FROM (SELECT *, l_tax AS paid, l_partkey AS row_id FROM lineitem)"
        for c in _leak_columns
    ),
)
def leakage_columns(spark, folder):
    df = table(spark, folder, "lineitem").withColumns({"paid": F.col("l_tax"), "row_id": F.col("l_partkey")})
    return X.leakage_report(df.select(*_leak_columns, "l_extendedprice"), "l_extendedprice")


@query(
    "drop_leakage_events", "PRJ-3",
    sql="SELECT event_type, value, props FROM events",
)
def drop_leakage_events(spark, folder):
    return X.drop_leakage(table(spark, folder, "events").drop("ts"), "value")[0]


@query("numeric_columns_part", "PRJ-4", sql="SELECT p_partkey, p_size, p_retailprice FROM part")
def numeric_columns_part(spark, folder):
    return X.numeric_only(table(spark, folder, "part"))


@query(
    "expected_columns_part", "PRJ-8",
    sql="SELECT p_retailprice, 0.0::DOUBLE AS p_weight, coalesce(CASE WHEN p_size > 10 THEN p_size END, 0)::DOUBLE AS p_size FROM part",
)
def expected_columns_part(spark, folder):
    df = table(spark, folder, "part").withColumn("p_size", F.when(F.col("p_size") > 10, F.col("p_size")))
    return X.expected_columns(df, ["p_retailprice", "p_weight", "p_size"])


@query(
    "one_hot_orders", "FEA-1",
    sql="""
    SELECT o_orderkey,
      CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS o_orderstatus_O,
      CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END::DOUBLE AS o_orderstatus_P FROM orders
    """,
)
def one_hot_orders(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return X.one_hot(df, {"o_orderstatus": X.categories(df, "o_orderstatus")})


@query(
    "one_hot_long_part", "FEA-1",
    sql=" UNION ALL ".join(
        f"SELECT p_partkey, '{c}_' || {c} AS feature, 1.0::DOUBLE AS value FROM part WHERE {c} <> (SELECT min({c}) FROM part)"
        for c in ("p_name", "p_brand")
    ),
)
def one_hot_long_part(spark, folder):
    return X.one_hot_long(table(spark, folder, "part"), ["p_partkey"], ["p_name", "p_brand"])


@query(
    "label_encode_priority", "FEA-2",
    sql="""
    WITH c AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1.0 AS i
      FROM (SELECT DISTINCT o_orderpriority FROM orders))
    SELECT o_orderkey, i::DOUBLE AS label, v AS decoded FROM orders JOIN c ON o_orderpriority = v
    """,
)
def label_encode_priority(spark, folder):
    df = table(spark, folder, "orders")
    labels = X.categories(df, "o_orderpriority")
    out = df.select("o_orderkey", X.label_index(F.col("o_orderpriority"), labels).alias("label"))
    return out.withColumn("decoded", X.label_text(F.col("label"), labels))


@query(
    "join_text_columns", "FEA-4",
    sql="""
    SELECT p_partkey, p_name || ' ' || coalesce(CASE WHEN p_size > 25 THEN p_type END, '') || ' ' || p_brand AS joined FROM part
    """,
)
def join_text_columns(spark, folder):
    df = table(spark, folder, "part").withColumn("p_type", F.when(F.col("p_size") > 25, F.col("p_type")))
    return df.select("p_partkey", X.joined_text(["p_name", "p_type", "p_brand"]).alias("joined"))


_stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(
    "tfidf_documents", "FEA-5",
    sql=f"""
    WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
        lambda x : x NOT IN ({_stop})) AS w FROM documents),
    e AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL
      SELECT doc_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i : w[i] || ' ' || w[i + 1])) AS term FROM w),
    c AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY 1, 2),
    v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY 1
      HAVING count(*) <= 0.95 * (SELECT count(*) FROM documents) ORDER BY 2 DESC, 1 LIMIT 200),
    r AS (SELECT doc_id, c.term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS raw FROM c JOIN v USING (term))
    SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r
    """,
)
def tfidf_documents(spark, folder):
    return rounded(T.tfidf(spread_table(spark, folder, "documents"), "doc_id", "text"), "weight")


@query(
    "encode_for_scoring", "FEA-6",
    sql="""
    WITH n AS (SELECT o_orderkey, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS price,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'NEW' ELSE o_orderstatus END AS status FROM orders),
    m AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM orders)
    SELECT o_orderkey, round((coalesce(price, 0) - a) / s, 6) AS o_totalprice,
      CASE WHEN status = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS o_orderstatus_O,
      CASE WHEN status = 'P' THEN 1.0 ELSE 0.0 END::DOUBLE AS o_orderstatus_P FROM n, m
    """,
)
def encode_for_scoring(spark, folder):
    from tabwright.operators.clean import fit_scale

    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    encoder = X.fit_encoder(df, "o_orderpriority", keys=["o_orderkey"])
    encoder.scales = fit_scale(df, ["o_totalprice"])
    fresh = df.withColumns(
        {
            "o_totalprice": F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")),
            "o_orderstatus": F.when(F.col("o_orderpriority") == "1-URGENT", "NEW").otherwise(F.col("o_orderstatus")),
        }
    )
    return rounded(encoder.encode(fresh, ["o_orderkey"]), "o_totalprice")


@query(
    "assemble_orders", "FEA-3", "UDF-2",
    sql="""
    SELECT o_orderkey, 3 AS n_features, round(o_totalprice + CASE WHEN o_orderstatus IN ('O', 'P') THEN 1 ELSE 0 END, 4) AS sum_of_features
    FROM orders
    """,
)
def assemble_orders(spark, folder):
    from pyspark.ml.functions import vector_to_array

    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    encoder = X.fit_encoder(df, "o_orderpriority", keys=["o_orderkey"])
    vectors = X.assemble(encoder.encode(df, ["o_orderkey"]), encoder.feature_names)
    values = vector_to_array("features")
    return vectors.select(
        "o_orderkey",
        F.size(values).alias("n_features"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), 4).alias("sum_of_features"),
    )


@query(
    "train_test_split", "FEA-7",
    sql="""
    SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY 1
    """,
)
def train_test_split(spark, folder):
    train, test = sampling.split_by_number(table(spark, folder, "orders"), "o_orderkey")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("hash_split_sizes", "FEA-7", "EVL-5")
def hash_split_sizes(spark, folder):
    """Five hash splits with different seeds: rows on each side."""
    df = table(spark, folder, "orders").select("o_orderkey")
    marks = [
        F.avg((sampling.unit_hash("o_orderkey", seed=sampling.SEED + i) < 0.2).cast("double")).alias(f"test_share_{i}")
        for i in range(5)
    ]
    return df.agg(F.count("*").alias("n"), *marks)


@query("evenly_spread_sample", "FEA-8")
def evenly_spread_sample(spark, folder):
    return sampling.evenly_spread(table(spark, folder, "orders"), ["o_orderkey"])


@query("pick_without_replacement", "FEA-9")
def pick_without_replacement(spark, folder):
    return sampling.pick(table(spark, folder, "orders"), ["o_orderkey"], 60)
