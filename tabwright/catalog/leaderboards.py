"""Leaderboard, activity and usage queries; events and orders stand in for the result store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, table
from tabwright.catalog.profiling import rounded
from tabwright.operators import leaderboard as B
from tabwright.operators import usage as U

TYPES = ("signup", "purchase", "view", "click", "error")


def day_text(df, *names):
    for name in names:
        df = df.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return df


def sql_time(column):
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def entries(spark, folder):
    """Events read as leaderboard entries: type as algorithm, value as score."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("model_id"), F.col("event_type").alias("algorithm"), F.col("value").alias("score"),
        F.col("ts").alias("created_at"), "user_id",
    )


@query(
    "rank_entries", "WIN-1", "SRT-1",
    sql="SELECT event_id AS model_id, value AS score, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events",
)
def rank_entries(spark, folder):
    return B.ranked(entries(spark, folder).select("model_id", "score"), "score", "model_id")


@query(
    "run_number", "WIN-2",
    sql="SELECT event_id AS model_id, event_type AS algorithm, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM events",
)
def run_number(spark, folder):
    return B.run_numbers(entries(spark, folder), "algorithm", "created_at", "model_id").select("model_id", "algorithm", "run")


@query(
    "run_trend", "WIN-2",
    sql="""
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM events)
    SELECT run, """
    + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in TYPES)
    + " FROM r GROUP BY run",
)
def run_trend(spark, folder):
    runs = B.run_numbers(entries(spark, folder), "algorithm", "created_at", "model_id")
    return B.run_trend(runs, "algorithm", "score", TYPES)


@query(
    "best_per_day", "AGG-7", "FUN-7",
    sql="""
    SELECT strftime(ts, '%Y-%m-%d') AS day, max(value) AS best, arg_max(event_type, (value, event_type)) AS best_group, count(*) AS n,
      strftime(ts::DATE, '%b %-d') AS label FROM events GROUP BY 1, 5
    """,
)
def best_per_day(spark, folder):
    return B.best_per_day(entries(spark, folder), "created_at", "score", "algorithm").withColumn(
        "day", F.date_format("day", "yyyy-MM-dd")
    )


@query(
    "score_per_type", "AGG-6",
    sql="SELECT event_type AS algorithm, count(*) AS n, round(avg(value), 6) AS mean_score FROM events GROUP BY 1",
)
def score_per_type(spark, folder):
    return rounded(B.per_group(entries(spark, folder), "algorithm", "score"), "mean_score")


@query(
    "leaderboard_totals", "AGG-8", "AGG-2",
    sql=f"""
    SELECT count(*) AS n, max(value) AS best, round(avg(value), 6) AS mean, round(sum(value), 2) AS total_duration,
      count(DISTINCT user_id) AS n_datasets, arg_max(event_type, (value, event_type)) AS best_group, {sql_time('max(ts)')} AS last_time,
      (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) AS most_used,
      count(DISTINCT event_type) AS n_groups FROM events
    """,
)
def leaderboard_totals(spark, folder):
    df = entries(spark, folder).withColumn("duration", F.col("score"))
    out = B.totals(df, "algorithm", "score", "duration", "user_id", "created_at")
    return day_text(rounded(rounded(out, "mean"), "total_duration", places=2), "last_time")


@query("top_models", "SRT-3", sql="SELECT event_id AS model_id, event_type AS algorithm, value AS score FROM events ORDER BY value DESC, event_id LIMIT 5")
def top_models(spark, folder):
    return B.top(entries(spark, folder).select("model_id", "algorithm", "score"), "score", "model_id")


@query(
    "newest_without_props", "SRT-2", "REG-4", "PRJ-6",
    sql=f"SELECT event_id, {sql_time('ts')} AS ts, user_id, event_type, value FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 50",
)
def newest_without_props(spark, folder):
    return day_text(B.newest(table(spark, folder, "events"), "ts", "event_id", 50, ["props"]), "ts")


@query(
    "first_per_customer_status", "WIN-4",
    sql="""
    WITH r AS (SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice,
      row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders)
    SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM r WHERE n = 1
    """,
)
def first_per_customer_status(spark, folder):
    df = table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    return B.first_per_key(df, ["o_custkey", "o_orderstatus"], ["o_orderkey"])


@query(
    "latest_per_user", "WIN-5", "REG-6",
    sql=f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT user_id, event_id, {sql_time('ts')} AS ts, event_type FROM r WHERE n = 1
    """,
)
def latest_per_user(spark, folder):
    df = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type")
    return day_text(B.latest_per_key(df, ["user_id"], ["ts", "event_id"]), "ts")


@query(
    "user_usage", "JOI-1", "REG-6",
    sql=f"""
    WITH u AS (SELECT user_id, min(ts) AS created FROM events GROUP BY 1)
    SELECT u.user_id, {sql_time('created')} AS created_at,
      (SELECT count(*) FROM events e WHERE e.user_id = u.user_id AND event_type = 'purchase') AS snapshots,
      (SELECT count(*) FROM events e WHERE e.user_id = u.user_id AND event_type = 'click') AS entries,
      {sql_time("coalesce((SELECT max(ts) FROM events e WHERE e.user_id = u.user_id AND event_type = 'view'), created)")} AS last_active FROM u
    """,
)
def user_usage(spark, folder):
    events = table(spark, folder, "events")
    users = events.groupBy("user_id").agg(F.min("ts").alias("created_at"))
    counted = {"snapshots": events.where("event_type = 'purchase'"), "entries": events.where("event_type = 'click'")}
    out = U.user_usage(users, "user_id", counted, events.where("event_type = 'view'"), "ts", "created_at")
    return day_text(out, "created_at", "last_active")


@query(
    "usage_totals", "AGG-5", "REG-5", "FUN-7",
    sql="""
    WITH n AS (SELECT max(ts) AS now FROM events)
    SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'signup') AS signups,
      count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'error') AS errors,
      count(*) FILTER (WHERE event_type = 'signup' AND ts >= now - INTERVAL 7 DAY) AS recent_signups FROM events, n
    """,
)
def usage_totals(spark, folder):
    events = table(spark, folder, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    kind = F.col("event_type")
    return U.counts_where(
        events,
        {
            "total": F.lit(True),
            "signups": kind == "signup",
            "purchases": kind == "purchase",
            "errors": kind == "error",
            "recent_signups": (kind == "signup") & U.since("ts", now),
        },
    )


def log(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", F.col("event_type").alias("action"), "ts")


@query(
    "activity_newest", "REG-7", "REG-1", "PRJ-5", "SRT-2",
    sql=f"SELECT event_id, user_id, event_type AS action, {sql_time('ts')} AS ts FROM events WHERE event_type = 'purchase' ORDER BY events.ts DESC, event_id DESC LIMIT 50",
)
def activity_newest(spark, folder):
    return day_text(U.activity(log(spark, folder), "ts", "event_id", "purchase"), "ts")


@query("activity_total", "REG-7", sql="SELECT count(*) AS total FROM events WHERE event_type = 'purchase'")
def activity_total(spark, folder):
    return U.activity_total(log(spark, folder), "purchase")


@query("prediction_counts", "REG-9", sql="SELECT user_id AS model_id, count(*) AS prediction_count FROM events WHERE event_type = 'click' GROUP BY 1")
def prediction_counts(spark, folder):
    clicks = table(spark, folder, "events").where("event_type = 'click'")
    return clicks.groupBy(F.col("user_id").alias("model_id")).agg(F.count("*").alias("prediction_count"))


@query(
    "snapshot_upsert", "REG-3",
    sql=f"""
    SELECT user_id, event_type AS fingerprint, {sql_time('min(ts)')} AS created_at, {sql_time('max(ts)')} AS updated_at,
      arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2
    """,
)
def snapshot_upsert(spark, folder):
    df = table(spark, folder, "events").select("user_id", F.col("event_type").alias("fingerprint"), "ts", "event_id", "value")
    return day_text(U.upserted(df, ["user_id", "fingerprint"], "ts", "event_id"), "created_at", "updated_at")


@query(
    "remove_user_rows", "REG-2", "REG-10",
    sql="SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 40)",
)
def remove_user_rows(spark, folder):
    events = table(spark, folder, "events")
    removed = events.where("event_type = 'error' AND value > 40")
    return U.without_keys(events, removed, ["user_id"]).select("event_id", "user_id")


@query(
    "filtered_orders", "PRJ-5",
    sql="""
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '1997-01-01'
    """,
)
def filtered_orders(spark, folder):
    df = table(spark, folder, "orders")
    return df.where(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") >= F.to_timestamp(F.lit("1997-01-01")))
    ).select("o_orderkey", "o_totalprice")


@query(
    "filter_entries_by_type", "PRJ-5", "SRT-1",
    sql="SELECT event_id AS model_id, value AS score FROM events WHERE event_type <> 'error' AND event_type = 'click' AND value > 10",
)
def filter_entries_by_type(spark, folder):
    df = entries(spark, folder).withColumns(
        {
            "algorithm": F.when(F.col("algorithm") == "error", "baseline").otherwise(F.col("algorithm")),
            "problem_type": F.when(F.col("score") > 10, "regression").otherwise("classification"),
        }
    )
    return B.filter_entries(df, "click", "regression").select("model_id", "score")


@query("search_part", "PRJ-7", sql="SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'ri') OR contains(lower(p_type), 'ri')")
def search_part(spark, folder):
    return B.search(table(spark, folder, "part"), ["p_name", "p_type"], "RI").select("p_partkey", "p_name", "p_type")


@query(
    "customers_without_orders", "JOI-2", "SET-2",
    sql="SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
)
def customers_without_orders(spark, folder):
    orders = table(spark, folder, "orders").where("o_totalprice > 300000")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    return B.not_in(customers, orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query(
    "selected_customers", "JOI-3",
    sql="SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def selected_customers(spark, folder):
    orders = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    return B.only_in(customers, orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query(
    "lookup_part", "JOI-10",
    sql="SELECT l_orderkey, l_linenumber, p_name, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey",
)
def lookup_part(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return B.lookup(lines, table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice"), ["p_partkey"]).drop("p_partkey")


@query(
    "fingerprints", "FUN-11", "FUN-8", "FUN-2",
    sql="""
    SELECT user_id, concat_ws('|', 'events', coalesce(CASE WHEN user_id >= 10 THEN 'value' END, 'unsupervised'),
      string_agg(DISTINCT event_type, ',' ORDER BY event_type), 'split') AS fingerprint FROM events GROUP BY 1
    """,
)
def fingerprints(spark, folder):
    per_user = table(spark, folder, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("algorithms"))
    target = F.when(F.col("user_id") >= 10, F.lit("value"))
    return per_user.select("user_id", B.fingerprint(F.lit("events"), target, F.col("algorithms"), F.lit("split")).alias("fingerprint"))


@query(
    "entry_scores_from_maps", "FUN-9", "FUN-10",
    sql="""
    SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN value <> 0 THEN value ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END
      ELSE 0.0 END::DOUBLE AS score, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || '}' AS json FROM events
    """,
)
def entry_scores_from_maps(spark, folder):
    props = F.from_json("props", "k long")
    metrics = F.create_map(F.lit("f1"), F.col("value"), F.lit("accuracy"), props["k"].cast("double"))
    kind = F.when(F.col("event_type") == "click", "classification").otherwise("regression")
    return table(spark, folder, "events").select(
        "event_id", B.entry_score(kind, metrics).alias("score"), props["k"].alias("k"), F.to_json(props).alias("json")
    )


@query(
    "sets_of_customers", "SET-1", "SET-2",
    sql="""
    WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
    SELECT 'either' AS which, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'first only', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
    """,
)
def sets_of_customers(spark, folder):
    orders = table(spark, folder, "orders")
    a, b = (orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    either = a.union(b).distinct().select(F.lit("either").alias("which"), "k")
    return either.unionByName(a.subtract(b).select(F.lit("first only").alias("which"), "k"))


@query(
    "best_model_per_user", "SCO-7",
    sql="SELECT user_id, arg_max(event_id, (value, -event_id)) AS model_id, max(value) AS score FROM events GROUP BY 1",
)
def best_model_per_user(spark, folder):
    df = table(spark, folder, "events").select("user_id", F.col("event_id").alias("model_id"), F.col("value").alias("score"), F.col("event_id").alias("position"))
    return B.best_model(df, "user_id")
