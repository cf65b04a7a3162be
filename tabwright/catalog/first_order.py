"""Models by gradient steps and by expectation rounds, next to SQL that repeats every round."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.catalog.base import query, spread_table
from tabwright.catalog.clusters import order_points
from tabwright.catalog.models import statuses
from tabwright.catalog.profiling import rounded
from tabwright.operators import descent as D
from tabwright.operators import mixture as X

EPOCHS = 20

_orders = """o AS (SELECT o_orderkey, o_totalprice / 100000.0 AS a, month(o_orderdate) / 12.0 AS b, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders)"""


def finished_orders(spark, folder):
    """Orders with two small numbers and whether they are finished."""
    return spread_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_totalprice") / 100000.0).alias("a"),
        (F.month("o_orderdate") / 12.0).alias("b"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("label"),
    )


def _rows(spark, model):
    """(class, term, weight) of a model."""
    names = ["intercept", *model.features]
    own = model.classes if len(model.weights) > 1 else model.classes[-1:]
    rows = [(c, n, w) for c, weights in zip(own, model.weights, strict=True) for n, w in zip(names, weights, strict=True)]
    return rounded(spark.createDataFrame(rows, "class double, term string, weight double"), "weight", places=9)


@query(
    "logistic_steps_orders", "SUP-5",
    sql=f"""
    WITH RECURSIVE {_orders},
    w(epoch, w0, w1, w2) AS (
      SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
      UNION ALL
      SELECT epoch + 1, w0 - 0.3 * avg(e), w1 - 0.3 * (avg(e * a) + 0.01 * w1), w2 - 0.3 * (avg(e * b) + 0.01 * w2)
      FROM (SELECT w.*, o.a, o.b, 1 / (1 + exp(-(w0 + w1 * a + w2 * b))) - y AS e FROM w, o WHERE epoch < {EPOCHS})
      GROUP BY epoch, w0, w1, w2)
    SELECT 1.0::DOUBLE AS class, term, round(weight, 9) AS weight FROM (
      SELECT 'intercept' AS term, w0 AS weight FROM w WHERE epoch = {EPOCHS} UNION ALL
      SELECT 'a', w1 FROM w WHERE epoch = {EPOCHS} UNION ALL SELECT 'b', w2 FROM w WHERE epoch = {EPOCHS})
    """,
)
def logistic_steps_orders(spark, folder):
    """Weights of a logistic model after 20 full-batch steps."""
    return _rows(spark, D.fit_logistic(finished_orders(spark, folder), ["a", "b"], "label", 0.3, EPOCHS, 0.01))


def _svm_sql(c: int) -> str:
    return f"""s{c}(epoch, w0, w1, w2) AS (
      SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
      UNION ALL
      SELECT epoch + 1, w0 + 0.1 * avg(g), w1 + 0.1 * (avg(g * a) - w1 / count(*)), w2 + 0.1 * (avg(g * b) - w2 / count(*))
      FROM (SELECT s.*, z.a, z.b, CASE WHEN t * (w0 + w1 * a + w2 * b) < 1 THEN t ELSE 0.0 END AS g
        FROM s{c} s, (SELECT a, b, CASE WHEN y = {c} THEN 1.0::DOUBLE ELSE -1.0 END AS t FROM z) z WHERE epoch < {EPOCHS})
      GROUP BY epoch, w0, w1, w2)"""


@query(
    "svm_steps_status", "SUP-10",
    sql=f"""
    WITH RECURSIVE r AS (SELECT o_totalprice::DOUBLE AS a, month(o_orderdate)::DOUBLE AS b,
        CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y FROM orders),
    m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM r),
    z AS (SELECT (a - ma) / sa AS a, (b - mb) / sb AS b, y FROM r, m),
    {", ".join(_svm_sql(c) for c in range(3))}
    SELECT class::DOUBLE AS class, term, round(weight, 9) AS weight FROM (
      {" UNION ALL ".join(f"SELECT {c} AS class, '{t}' AS term, w{i} AS weight FROM s{c} WHERE epoch = {EPOCHS}" for c in range(3) for i, t in enumerate(("intercept", "o_totalprice", "month")))})
    """,
)
def svm_steps_status(spark, folder):
    """Weights of three one-against-the-rest support-vector models after 20 steps."""
    df, features = statuses(spark, folder)
    return _rows(spark, D.fit_svm(df, features, "label", 1.0, 0.1, EPOCHS))


_START = [[-1.0, -1.0], [0.0, 0.5], [1.0, 0.0]]
_ROUNDS = 6


def _mixture_sql() -> str:
    """All rounds unrolled: m{r} has a row per component, e{r} the shares of every point."""
    centers = ", ".join(f"({c}, {1 / 3!r}::DOUBLE, {x}::DOUBLE, {y}::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE)" for c, (x, y) in enumerate(_START))
    out = [f"m0(c, weight, mx, my, vx, vy) AS (VALUES {centers})"]
    for r in range(_ROUNDS):
        out += [
            f"""l{r} AS (SELECT z.id, z.x, z.y, m.c, ln(weight + 1e-300) - 0.5 * ln(2 * pi() * vx) - (x - mx) ** 2 / (2 * vx)
              - 0.5 * ln(2 * pi() * vy) - (y - my) ** 2 / (2 * vy) AS l FROM z, m{r} m)""",
            f"t{r} AS (SELECT id, ln(sum(exp(l))) AS total FROM l{r} GROUP BY id)",
            f"e{r} AS (SELECT l.id, l.x, l.y, l.c, exp(l.l - t.total) AS p FROM l{r} l JOIN t{r} t ON t.id = l.id)",
            f"""a{r} AS (SELECT c, sum(p) AS n, sum(p * x) / sum(p) AS mx, sum(p * y) / sum(p) AS my FROM e{r} GROUP BY c)""",
            f"""m{r + 1} AS (SELECT a.c, n / (SELECT count(*) FROM z) AS weight, a.mx, a.my,
              greatest(sum(p * (x - a.mx) ** 2) / n, 1e-6) AS vx, greatest(sum(p * (y - a.my) ** 2) / n, 1e-6) AS vy
              FROM e{r} e JOIN a{r} a ON a.c = e.c GROUP BY a.c, a.n, a.mx, a.my)""",
        ]
    return ",\n".join(out)


@query(
    "mixture_rounds_orders", "UNS-5",
    sql=f"""
    WITH g AS (SELECT avg(o_totalprice) AS a1, stddev_pop(o_totalprice) AS s1, avg(datediff('day', DATE '1970-01-01', o_orderdate)) AS a2,
        stddev_pop(datediff('day', DATE '1970-01-01', o_orderdate)) AS s2 FROM orders),
    z AS (SELECT o_orderkey AS id, (o_totalprice - a1) / s1 AS x, (datediff('day', DATE '1970-01-01', o_orderdate) - a2) / s2 AS y FROM orders, g),
    {_mixture_sql()}
    SELECT c AS cluster, round(weight, 6) AS weight, round(mx, 6) AS mean_0, round(my, 6) AS mean_1, round(vx, 6) AS variance_0,
      round(vy, 6) AS variance_1, round((SELECT sum(total) FROM t{_ROUNDS - 1}), 2) AS log_likelihood FROM m{_ROUNDS}
    """,
)
def mixture_rounds_orders(spark, folder):
    """Weights, means and variances of a mixture after six rounds from given centers."""
    found = X.diagonal_mixture(order_points(spark, folder), _START, _ROUNDS)
    rows = [
        (c, *map(float, values))
        for c, values in enumerate(
            (found.weights[c], *found.centers[c], *found.variances[c], found.log_likelihoods[-1]) for c in range(len(_START))
        )
    ]
    out = spark.createDataFrame(
        rows, "cluster int, weight double, mean_0 double, mean_1 double, variance_0 double, variance_1 double, log_likelihood double"
    )
    out = rounded(out, "weight", "mean_0", "mean_1", "variance_0", "variance_1")
    return rounded(out, "log_likelihood", places=2)
