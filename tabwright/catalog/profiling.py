"""Column profiles, typing, shapes and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, spread_table, sql_order_stat, table
from tabwright.operators import profile as P
from tabwright.operators import targets as G

LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINEITEM_WORDS = ["l_returnflag", "l_linestatus"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART_COLUMNS = [
    ("p_partkey", True), ("p_name", False), ("p_brand", False), ("p_type", False), ("p_size", True),
    ("p_retailprice", True),
]


def sql_profile(source: str, columns: list[tuple[str, bool]]) -> str:
    """Profile of (name, is numeric) columns, unrounded."""
    parts = []
    for i, (name, numeric) in enumerate(columns):
        spread = (
            f"min({name})::DOUBLE AS min, max({name})::DOUBLE AS max, avg({name})::DOUBLE AS mean, stddev_pop({name}) AS std"
            if numeric
            else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std"
        )
        parts.append(
            f"SELECT {i} AS position, '{name}' AS name, '{'numeric' if numeric else 'categorical'}' AS type, "
            f"count(DISTINCT {name}) + max(CASE WHEN {name} IS NULL THEN 1 ELSE 0 END) AS n_unique, "
            f"count(*) - count({name}) AS n_missing, {spread} FROM {source}"
        )
    return " UNION ALL ".join(parts)


def rounded(df, *names, places=6):
    for name in names:
        df = df.withColumn(name, F.round(name, places))
    return df


def blanked(spark, folder):
    """lineitem with missing cells made by rule, as no test table has any."""
    return spread_table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        "l_extendedprice",
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_linenumber") != 5, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
    )


SQL_BLANKED = (
    "(SELECT l_orderkey, l_quantity, l_extendedprice, "
    "CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount, "
    "CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS l_returnflag, l_linestatus FROM lineitem) AS b"
)
BLANKED_COLUMNS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]

_rounded_profile = (
    "SELECT name, type, n_unique, n_missing, round(min, 6) AS min, round(max, 6) AS max, "
    "round(mean, 4) AS mean, round(std, 4) AS std FROM ({})"
)


@query(
    "profile_lineitem", "PRO-1", "AGG-1", "AGG-2", "FUN-3",
    sql=_rounded_profile.format(
        sql_profile("lineitem", [*[(c, True) for c in LINEITEM_NUMBERS], *[(c, False) for c in LINEITEM_WORDS]])
    ),
)
def profile_lineitem(spark, folder):
    df = P.profile(spread_table(spark, folder, "lineitem").select(*LINEITEM_NUMBERS, *LINEITEM_WORDS))
    return rounded(rounded(df, "min", "max"), "mean", "std", places=4).drop("position")


@query(
    "profile_with_missing", "PRO-1", "PRO-4",
    sql=_rounded_profile.format(
        sql_profile(SQL_BLANKED, [(c, not c.startswith(("l_return", "l_line"))) for c in BLANKED_COLUMNS])
    ),
)
def profile_with_missing(spark, folder):
    df = P.profile(blanked(spark, folder))
    return rounded(rounded(df, "min", "max"), "mean", "std", places=4).drop("position")


@query(
    "sample_values_part", "PRO-1", "AGG-2", "FUN-8",
    sql="""
    WITH v AS (SELECT DISTINCT name, value FROM part UNPIVOT (value FOR name IN (p_name, p_brand, p_type))),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value) AS place FROM v)
    SELECT name, string_agg(value, '|' ORDER BY value) AS sample FROM r WHERE place <= 10 GROUP BY name
    """,
)
def sample_values_part(spark, folder):
    df = P.sample_values(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"])
    return df.select("name", F.array_join("sample", "|").alias("sample"))


def _texts(spark, folder):
    k = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("event"),
        "event_type",
        F.when(F.col("event_type") != "error", k).otherwise("").alias("k_or_blank"),
        F.when(F.col("event_type") == "click", F.col("event_type")).otherwise(k).alias("k_or_word"),
    )


_typing_source = (
    "(SELECT CAST(event_id AS VARCHAR) AS event, event_type, "
    "CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') ELSE '' END AS k_or_blank, "
    "CASE WHEN event_type = 'click' THEN event_type ELSE json_extract_string(props, '$.k') END AS k_or_word FROM events)"
)


def _typing_sql(name):
    present = f"count(CASE WHEN trim({name}) <> '' THEN 1 END)"
    numbers = f"count(try_cast({name} AS DOUBLE))"
    return (
        f"SELECT '{name}' AS name, {present} AS n_present, {numbers} AS n_numbers, "
        f"CASE WHEN {numbers} = count(*) AND {numbers} > 0 THEN 'numeric' ELSE 'categorical' END AS strict_type, "
        f"CASE WHEN {numbers} > {present} * 0.5 THEN 'numeric' ELSE 'categorical' END AS majority_type FROM {_typing_source}"
    )


TYPED = ["event", "event_type", "k_or_blank", "k_or_word"]


@query("column_typing_events", "PRO-2", "FUN-1", sql=" UNION ALL ".join(map(_typing_sql, TYPED)))
def column_typing_events(spark, folder):
    return P.column_typing(_texts(spark, folder), TYPED)


@query(
    "text_columns_documents", "PRO-3", "FUN-2",
    sql=" UNION ALL ".join(
        f"SELECT '{c}' AS name, round(avg(length(coalesce({c}, ''))), 6) AS mean_length, "
        f"avg(length(coalesce({c}, ''))) > 20 AS is_text FROM documents"
        for c in ("text", "lang", "source")
    ),
)
def text_columns_documents(spark, folder):
    return rounded(P.text_columns(table(spark, folder, "documents")), "mean_length")


@query(
    "missing_cells", "PRO-4",
    sql=" UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) - count({c}) AS n_missing, "
        f"round((count(*) - count({c})) / count(*) * 100, 1) AS pct FROM {SQL_BLANKED}"
        for c in BLANKED_COLUMNS
    ),
)
def missing_cells(spark, folder):
    return P.missing_cells(blanked(spark, folder))


@query(
    "completeness", "PRO-23",
    sql=f"""
    SELECT {" + ".join(f"count(*) - count({c})" for c in BLANKED_COLUMNS)} AS n_missing, count(*) * 6 AS n_cells,
      round(1 - ({" + ".join(f"count(*) - count({c})" for c in BLANKED_COLUMNS)}) / (count(*) * 6), 6) AS completeness
    FROM {SQL_BLANKED}
    """,
)
def completeness(spark, folder):
    return rounded(P.completeness(blanked(spark, folder)), "completeness")


@query(
    "duplicate_rows_documents", "PRO-5",
    sql="""
    SELECT (SELECT count(*) FROM documents) AS n_rows,
      (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS n_duplicates
    """,
)
def duplicate_rows_documents(spark, folder):
    return P.duplicate_rows(table(spark, folder, "documents").select("text", "lang"))


_with_constants = (
    "(SELECT *, 'same' AS one_word, NULL::DOUBLE AS nothing, CASE WHEN c_nationkey < 12 THEN 1 END AS one_or_missing FROM customer)"
)


@query(
    "constant_columns", "PRO-7",
    sql="SELECT name FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_values FROM {_with_constants}"
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "one_word", "nothing", "one_or_missing")
    )
    + ") WHERE n_values <= 1",
)
def constant_columns(spark, folder):
    df = table(spark, folder, "customer").withColumns(
        {
            "one_word": F.lit("same"),
            "nothing": F.lit(None).cast("double"),
            "one_or_missing": F.when(F.col("c_nationkey") < 12, F.lit(1)),
        }
    )
    return P.constant_columns(df)


def _corr_sql(source, x, y):
    r = (
        f"CASE WHEN var_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) = 0 OR var_pop(CASE WHEN {x} IS NOT NULL THEN {y} END) = 0 "
        f"THEN 0 ELSE corr({x}, {y}) END"
    )
    return f"SELECT '{x}' AS x, '{y}' AS y, {r} AS r FROM {source}"


_linked = "(SELECT *, p_retailprice * 2 + p_size AS price2, -p_retailprice AS price3 FROM part)"


def _linked_part(spark, folder):
    df = table(spark, folder, "part")
    return df.withColumns({"price2": F.col("p_retailprice") * 2 + F.col("p_size"), "price3": -F.col("p_retailprice")})


_linked_columns = ["p_partkey", "p_size", "p_retailprice", "price2", "price3"]


@query(
    "high_correlations_part", "PRO-8",
    sql="SELECT x, y, round(r, 3) AS r FROM ("
    + " UNION ALL ".join(_corr_sql(_linked, x, y) for x, y in P.all_pairs(_linked_columns))
    + ") WHERE abs(r) > 0.9",
)
def high_correlations_part(spark, folder):
    return P.high_correlations(_linked_part(spark, folder), _linked_columns)


_matrix_columns = [*MEASURES, "l_linenumber"]


@query(
    "corr_matrix_lineitem", "PRO-21",
    sql="SELECT x, y, round(r, 6) + 0.0 AS r FROM ("
    + " UNION ALL ".join(_corr_sql("lineitem", x, y) for x in _matrix_columns for y in _matrix_columns)
    + ")",
)
def corr_matrix_lineitem(spark, folder):
    return rounded(P.correlation_matrix(spread_table(spark, folder, "lineitem"), _matrix_columns), "r")


@query(
    "graded_correlation_lineitem", "PRO-22",
    sql="""
    WITH c AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem)
    SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, n, round(r, 6) AS r,
      CASE WHEN abs(r) >= 0.8 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' WHEN abs(r) >= 0.3 THEN 'weak'
        ELSE 'very weak' END AS grade,
      CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS insight_grade,
      CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction
    FROM c
    """,
)
def graded_correlation_lineitem(spark, folder):
    return rounded(P.graded_correlation(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"), "r")


@query(
    "scatter_points_part", "PRO-22",
    sql="SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL",
)
def scatter_points_part(spark, folder):
    return P.scatter_points(table(spark, folder, "part"), "p_size", "p_retailprice")


@query(
    "target_check_orders", "PRO-9",
    sql="""
    WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1)
    SELECT 'o_orderstatus' AS target, count(*) AS n_unique, 'classification' AS task,
      round(max(n) / sum(n) * 100, 1) AS majority_pct, max(n) / sum(n) > 0.8 AS imbalanced FROM c
    """,
)
def target_check_orders(spark, folder):
    return P.target_check(table(spark, folder, "orders"), "o_orderstatus")


_ranges = " , ".join(f"max({c})::DOUBLE - min({c})::DOUBLE" for c in LINEITEM_NUMBERS)


@query(
    "scale_spread_lineitem", "PRO-10",
    sql=f"""
    WITH r AS (SELECT list_filter([{_ranges}], lambda v : v > 0) AS ranges FROM lineitem)
    SELECT len(ranges) AS n_ranges, round(list_max(ranges) / list_min(ranges), 4) AS ratio,
      len(ranges) > 1 AND list_max(ranges) / list_min(ranges) > 100 AS scale_issue FROM r
    """,
)
def scale_spread_lineitem(spark, folder):
    return rounded(P.scale_spread(table(spark, folder, "lineitem"), LINEITEM_NUMBERS), "ratio", places=4)


_targets = {"l_quantity": True, "l_discount": True, "l_extendedprice": True, "l_returnflag": False, "l_linestatus": False}


@query(
    "problem_type_lineitem", "FEA-10", "PRO-15",
    sql=" UNION ALL ".join(
        f"SELECT '{c}' AS target, count(DISTINCT {c}) AS n_unique, count(*) AS n_rows, "
        + (
            f"CASE WHEN count(DISTINCT {c}) = 2 OR count(DISTINCT {c}) / count(*) < 0.05 THEN 'classification' ELSE 'regression' END"
            if numeric
            else "'classification'"
        )
        + " AS problem_type FROM lineitem"
        for c, numeric in _targets.items()
    ),
)
def problem_type_lineitem(spark, folder):
    df = table(spark, folder, "lineitem")
    out = [P.problem_type(df, c).withColumn("target", F.lit(c)) for c in _targets]
    joined = out[0]
    for part in out[1:]:
        joined = joined.unionByName(part)
    return joined


@query(
    "five_numbers_totalprice", "PRO-19", "AGG-1",
    sql="""
    SELECT 'o_totalprice' AS name, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean,
      round(stddev_pop(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max,
      round(quantile_cont(o_totalprice, 0.5), 6) AS median FROM orders
    """,
)
def five_numbers_totalprice(spark, folder):
    df = P.five_numbers(table(spark, folder, "orders"), "o_totalprice")
    return rounded(rounded(df, "mean", "std", places=4), "median")


@query(
    "histogram_totalprice", "PRO-20",
    sql="""
    WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi,
        least(20, greatest(5, CAST(ceil(sqrt(count(*))) AS BIGINT))) AS bins FROM orders),
    w AS (SELECT lo, bins, (hi - lo) / bins AS width FROM s),
    c AS (SELECT least(CAST(floor((o_totalprice - lo) / width) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM orders, w GROUP BY 1),
    g AS (SELECT unnest(range(bins)) AS bin FROM w)
    SELECT g.bin, round(lo + g.bin * width, 4) AS low, round(lo + (g.bin + 1) * width, 4) AS high, coalesce(n, 0) AS n
    FROM g CROSS JOIN w LEFT JOIN c ON c.bin = g.bin
    """,
)
def histogram_totalprice(spark, folder):
    return rounded(P.histogram(table(spark, folder, "orders"), "o_totalprice"), "low", "high", places=4)


@query(
    "rare_category_part", "PRO-18", "AGG-13",
    sql="""
    SELECT p_name || ' / ' || p_type AS category, count(*) AS n,
      count(*) < greatest(2, (SELECT count(*) FROM part) * 0.02) AS rare FROM part GROUP BY 1
    """,
)
def rare_category_part(spark, folder):
    df = table(spark, folder, "part").select(F.concat_ws(" / ", "p_name", "p_type").alias("kind"))
    return P.category_counts(df, "kind")


@query(
    "scenario_defaults_part", "PRO-17",
    sql=" UNION ALL ".join(
        [
            f"SELECT '{c}' AS feature, 'numeric' AS type, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
            f"round(avg({c}), 4) AS mean, {sql_order_stat(c, 0.5)}::DOUBLE AS median, "
            f"format('{{:.2f}}', {sql_order_stat(c, 0.5)}::DOUBLE) AS default_value, NULL AS categories FROM part"
            for c in ("p_size", "p_retailprice")
        ]
        + [
            f"SELECT '{c}' AS feature, 'categorical' AS type, NULL AS min, NULL AS max, NULL AS mean, NULL AS median, "
            f"min(v) AS default_value, string_agg(v, '|' ORDER BY v) AS categories "
            f"FROM (SELECT DISTINCT {c} AS v FROM part WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 30)"
            for c in ("p_brand", "p_type")
        ]
    ),
)
def scenario_defaults_part(spark, folder):
    df = P.scenario_defaults(table(spark, folder, "part"), ["p_size", "p_retailprice", "p_brand", "p_type"])
    return rounded(df, "mean", places=4).withColumnRenamed("default", "default_value")


_part_profile = sql_profile("part", PART_COLUMNS)


def _profile_of_part(spark, folder):
    df = table(spark, folder, "part")
    return P.profile(df), df.count()


@query(
    "key_variables_part", "PRO-14", "SRT-3",
    sql=f"""
    SELECT name, type, CASE WHEN type = 'numeric' AND std > 0 THEN 3 ELSE 0 END
      + CASE WHEN type = 'categorical' AND n_unique BETWEEN 2 AND 10 THEN 4 ELSE 0 END
      + CASE WHEN n_unique = 2 THEN 2 ELSE 0 END + CASE WHEN n_missing = 0 THEN 1 ELSE 0 END AS score
    FROM ({_part_profile}) ORDER BY score DESC, position LIMIT 5
    """,
)
def key_variables_part(spark, folder):
    return G.key_variables(_profile_of_part(spark, folder)[0])


_amounts, _outcomes, _identities = ("|".join(w) for w in (G.AMOUNT_WORDS, G.OUTCOME_WORDS, G.IDENTITY_WORDS))


@query(
    "suggest_target_part", "PRO-12",
    sql=f"""
    WITH p AS (SELECT *, type = 'numeric' AND n_unique > 10 AND std > 0 AS varied,
        type = 'categorical' AND n_unique BETWEEN 2 AND 10 AS classes,
        regexp_matches(lower(name), '{_amounts}') AS amount, regexp_matches(lower(name), '{_outcomes}') AS outcome
      FROM ({_part_profile})),
    r AS (SELECT *, CASE WHEN varied AND (amount OR outcome) THEN 1 WHEN classes AND outcome THEN 2
        WHEN classes THEN 3 WHEN varied THEN 4 END AS rule FROM p)
    SELECT name, rule, CASE WHEN type = 'numeric' THEN 'regression' ELSE 'classification' END AS task
    FROM r WHERE rule IS NOT NULL ORDER BY rule, CASE WHEN rule = 3 THEN n_unique ELSE 0 END, position LIMIT 1
    """,
)
def suggest_target_part(spark, folder):
    return G.suggest_target(_profile_of_part(spark, folder)[0])


_score_sql = f"""
    WITH p AS (SELECT *, regexp_matches(lower(name), '{_amounts}') AS amount, regexp_matches(lower(name), '{_outcomes}') AS outcome,
        regexp_matches(lower(name), '{_identities}') AS identity, (SELECT count(*) FROM part) AS n FROM ({_part_profile})),
    s AS (SELECT position, name, CASE WHEN type = 'categorical' THEN 'classification' ELSE 'regression' END AS task,
        CASE WHEN outcome THEN 20.0 ELSE 0.0 END + CASE WHEN amount AND type = 'numeric' THEN 25.0 ELSE 0.0 END
        + CASE WHEN type = 'categorical' AND n_unique BETWEEN 2 AND 10 THEN 20.0 - n_unique
            WHEN type = 'numeric' AND n_unique > 10 THEN 5.0
              + least(5.0, std / CASE WHEN abs(mean) > 0 THEN abs(mean) ELSE 1.0 END)
              + CASE WHEN n_unique > n * 0.5 THEN 8.0 ELSE 0.0 END ELSE 0.0 END
        - CASE WHEN identity THEN 30.0 ELSE 0.0 END
        - CASE WHEN n_unique > n * 0.8 AND NOT (type = 'numeric' AND (amount OR outcome)) THEN 20.0 ELSE 0.0 END AS score FROM p)
"""


@query("score_targets_part", "PRO-13", sql=f"{_score_sql} SELECT name, task, round(score::DOUBLE, 6) AS score FROM s")
def score_targets_part(spark, folder):
    columns, n = _profile_of_part(spark, folder)
    return rounded(G.score_targets(columns, n).drop("position"), "score")


@query(
    "best_target_part", "PRO-13",
    sql=f"{_score_sql} SELECT name, task, round(score::DOUBLE, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, position LIMIT 1",
)
def best_target_part(spark, folder):
    columns, n = _profile_of_part(spark, folder)
    return rounded(G.best_target(columns, n), "score")


@query(
    "suggest_task_part", "PRO-15",
    sql=f"""
    SELECT name, n_unique, CASE WHEN type <> 'numeric' THEN 'classification' WHEN n_unique = 2 THEN 'binary classification'
      WHEN n_unique / (SELECT count(*) FROM part) < 0.05 THEN 'multi-class classification' ELSE 'regression' END AS task
    FROM ({_part_profile})
    """,
)
def suggest_task_part(spark, folder):
    return G.suggest_task(*_profile_of_part(spark, folder))
