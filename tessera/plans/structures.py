"""Graphs of the star schema by colour refinement, sampled symbol sequences and the principal response."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import components, graphs, markov
from tessera.operators.windows import dealt, running
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6, table

_GRAPH = {
    "part_supplier": """
        n AS (SELECT p_partkey * 2 AS node, 'part' AS label FROM part UNION ALL SELECT s_suppkey * 2 + 1, 'supplier' FROM supplier),
        e AS (SELECT l_suppkey * 2 + 1 AS src, l_partkey * 2 AS dst, CASE WHEN max(l_quantity) >= 50 THEN 'full' ELSE 'part' END AS label FROM lineitem GROUP BY 1, 2)""",
    "customer_order": """
        n AS (SELECT c_custkey * 2 AS node, 'customer' AS label FROM customer UNION ALL SELECT o_orderkey * 2 + 1, o_orderstatus FROM orders),
        e AS (SELECT o_custkey * 2 AS src, o_orderkey * 2 + 1 AS dst, o_orderpriority AS label FROM orders)""",
}


def _refined_sql(graph: str, rounds: int) -> str:
    """Refinement by exact sorted lists, for a number of rounds in which the classes settle (further rounds change nothing)."""
    steps = [f"WITH {_GRAPH[graph]}", "b AS (SELECT dst AS node, src AS far, 'in' || label AS e FROM e UNION ALL SELECT src, dst, 'out' || label FROM e)", "c0 AS (SELECT node, dense_rank() OVER (ORDER BY label) AS c FROM n)"]
    for i in range(rounds):
        steps.append(f"s{i} AS (SELECT b.node, list(e || ':' || c ORDER BY e || ':' || c) AS l FROM b JOIN c{i} c ON c.node = b.far GROUP BY 1), c{i + 1} AS (SELECT c.node, dense_rank() OVER (ORDER BY c.c, coalesce(array_to_string(l, ','), '')) AS c FROM c{i} c LEFT JOIN s{i} s ON s.node = c.node)")
    return ", ".join(steps) + f" SELECT node, min(node) OVER (PARTITION BY c) AS class, count(*) OVER (PARTITION BY c) AS size FROM c{rounds}"


@register(_refined_sql("part_supplier", 8))
def part_supplier_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of parts and suppliers that refinement does not tell apart, joined by lines, some of them full (a quantity of 50)."""
    nodes = table(spark, d, "part").select((F.col("p_partkey") * 2).alias("node"), F.lit("part").alias("label")).unionByName(table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("node"), F.lit("supplier").alias("label")))
    pairs = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") * 2 + 1).alias("src"), (F.col("l_partkey") * 2).alias("dst"))
    edges = pairs.agg(F.when(F.max("l_quantity") >= 50, "full").otherwise("part").alias("label"))
    return graphs.classes(nodes, edges)


def order_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers and their orders as nodes, joined by edges that carry the priority."""
    o = table(spark, d, "orders")
    nodes = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("node"), F.lit("customer").alias("label")).unionByName(o.select((F.col("o_orderkey") * 2 + 1).alias("node"), F.col("o_orderstatus").alias("label")))
    return nodes, o.select((F.col("o_custkey") * 2).alias("src"), (F.col("o_orderkey") * 2 + 1).alias("dst"), F.col("o_orderpriority").alias("label"))


@register(_refined_sql("customer_order", 4))
def customer_order_classes(spark: SparkSession, d: str) -> DataFrame:
    """Customers with like orders, and orders of like customers."""
    return graphs.classes(*order_graph(spark, d))


_BINS, _DEPTH, _SEED, _STEPS = 4, 2, 7, 24


@register(f"""
WITH RECURSIVE v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events),
s AS (SELECT user_id, i, CASE WHEN hi > lo THEN least({_BINS - 1}, cast(floor((value - lo) / (hi - lo) * {_BINS}) AS INTEGER)) ELSE 0 END AS s FROM v),
p AS (SELECT user_id, s, lag(s, 1) OVER w AS a, lag(s, 2) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)),
k AS (SELECT user_id, a * {_BINS} + b AS context, s FROM p WHERE b IS NOT NULL UNION ALL SELECT user_id, -1, s FROM p),
c AS (SELECT user_id, context, g.s, 1 + count(*) FILTER (k.s = g.s) AS n FROM k CROSS JOIN (SELECT unnest(range({_BINS})) AS s) g GROUP BY 1, 2, 3),
u AS (SELECT user_id, context, s, sum(n) OVER (PARTITION BY user_id, context ORDER BY s) AS upto, sum(n) OVER (PARTITION BY user_id, context) AS total FROM c),
l AS (SELECT user_id, context, list(upto ORDER BY s) AS upto, any_value(total) AS total FROM u GROUP BY 1, 2), m AS (SELECT user_id, upto, total FROM l WHERE context = -1),
f AS (SELECT user_id, cast(-1 AS BIGINT) AS step, cast(NULL AS BIGINT) AS symbol, cast(0 AS BIGINT) AS context FROM m
UNION ALL
SELECT f.user_id, f.step + 1, x.symbol, f.context // {_BINS} + x.symbol * {_BINS ** (_DEPTH - 1)} FROM f JOIN m ON m.user_id = f.user_id LEFT JOIN l ON l.user_id = f.user_id AND l.context = f.context AND f.step + 1 >= {_DEPTH},
LATERAL (SELECT cast(len([y for y in coalesce(l.upto, m.upto) if y * 4294967296 <= cast('0x' || substr(md5('{_SEED}:' || f.user_id || ':' || (f.step + 1)), 1, 8) AS BIGINT) * coalesce(l.total, m.total)]) AS BIGINT) AS symbol) x WHERE f.step + 1 < {_STEPS})
SELECT user_id, cast(step AS INTEGER) AS step, cast(symbol AS INTEGER) AS symbol FROM f WHERE step >= 0
""")
def sampled_sequences(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sequence for each user from the context table of the user's values in four bins."""
    e = events(spark, d).withColumn("_one", F.lit(1))
    placed = running(dealt(e, key=["user_id"], by="t"), key=["user_id"], order=["t", "event_id"], sums={"i": "_one"})
    rows = markov.symbols(placed.select("user_id", "i", "value"), key="user_id", value="value", bins=_BINS)
    tables = markov.contexts(rows, key="user_id", order="i", bins=_BINS, depth=_DEPTH)
    return markov.sample(tables, key="user_id", steps=_STEPS, bins=_BINS, depth=_DEPTH, seed=_SEED)


@register()
def label_response(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's place on the first principal axis of all standardised vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return components.principal_response(e, "embedding").select("vec_id", r6("response").alias("response"))


@register("""
WITH v AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem),
m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM v), r AS (SELECT avg((a - ma) / sa * (b - mb) / sb) AS r FROM v CROSS JOIN m)
SELECT l_orderkey, l_linenumber, round(((l_quantity - ma) / sa + CASE WHEN r < 0 THEN -1 ELSE 1 END * (l_extendedprice - mb) / sb) / sqrt(2), 5) AS response FROM lineitem CROSS JOIN m CROSS JOIN r
""")
def line_response(spark: SparkSession, d: str) -> DataFrame:
    """Each line's place on the principal axis of quantity and price (in closed form for two metrics)."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_extendedprice").alias("x"))
    return components.principal_response(rows, "x").select("l_orderkey", "l_linenumber", F.round("response", 5).alias("response"))
