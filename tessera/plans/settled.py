"""How long programs move after a step: users are takes, two events a frame, purchases and errors write two parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.special import normal_cdf
from tessera.operators import settle
from tessera.operators.windows import dealt, running
from tessera.plans.catalogue import register
from tessera.plans.tables import events
from tessera.session import kept

PROGRAMS = 3
_TESTS = range(1, 4)
_CRITICAL = "CASE tests " + " ".join(f"WHEN {n} THEN {settle.critical(n)!r}" for n in _TESTS) + " END"
_LEAST = "CASE tests " + " ".join(f"WHEN {n} THEN {settle.least_steps(n)}" for n in _TESTS) + " END"

_SQL = f"""
WITH RECURSIVE e AS (SELECT user_id AS take, event_type, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events),
f AS (SELECT take, place // 2 AS frame, CASE WHEN count(*) FILTER (event_type = 'signup') < 2 THEN cast(sum(cast(round(value * 100) AS BIGINT)) AS BIGINT) END AS score FROM e GROUP BY 1, 2),
w AS (SELECT take, CASE event_type WHEN 'purchase' THEN 1 ELSE 2 END AS param, place, cast(least(7, floor(value / 10)) AS BIGINT) AS v FROM e WHERE event_type IN ('purchase', 'error')),
s AS (SELECT take, param, place // 2 AS frame FROM (SELECT *, coalesce(lag(v) OVER (PARTITION BY take, param ORDER BY place), 0) AS held FROM w) WHERE v <> held),
l AS (SELECT take, frame AS since, CASE WHEN count(*) = 1 THEN min(param) ELSE 0 END AS param FROM s GROUP BY 1, 2),
o AS (SELECT take, frame, score, max(since) OVER (PARTITION BY take ORDER BY frame) AS since FROM f LEFT JOIN (SELECT take, since, since AS frame FROM l) USING (take, frame)),
h AS (SELECT take, since, frame - since AS lag, score, count(*) OVER (PARTITION BY take, since) // 2 AS half FROM o WHERE since IS NOT NULL),
m AS (SELECT take, since, median(score) AS settled FROM h WHERE lag >= half GROUP BY 1, 2),
d AS (SELECT take % {PROGRAMS} AS program, param, lag, score - settled AS d FROM h JOIN m USING (take, since) JOIN l USING (take, since) WHERE lag < half AND score IS NOT NULL AND settled IS NOT NULL),
r AS (SELECT program, 0 AS param, lag, d FROM d UNION ALL SELECT * FROM d WHERE param > 0),
n AS (SELECT program, 1 + count(DISTINCT param) FILTER (param > 0) AS tests FROM d GROUP BY 1),
k AS (SELECT program, param, lag, d, rank() OVER (PARTITION BY program, param, lag ORDER BY abs(d)) + (count(*) OVER (PARTITION BY program, param, lag, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY program, param, lag, abs(d)) AS ties FROM r WHERE d <> 0),
q AS (SELECT program, param, lag, count(*) AS m, max(ties) AS tie, sum(r) FILTER (d > 0) AS plus, abs(sum(sign(d) * r)) / sqrt(sum(r * r)) AS z FROM k GROUP BY 1, 2, 3),
c AS (SELECT program, param, lag, count(*) AS steps FROM r GROUP BY 1, 2, 3),
ways AS (SELECT 0 AS size, [1.0::DOUBLE] AS ways UNION ALL SELECT size + 1, list_transform(range(0, (size + 1) * (size + 2) // 2 + 1), lambda x: CASE WHEN x < len(ways) THEN ways[x + 1] ELSE 0 END + CASE WHEN x >= size + 1 THEN ways[x - size] ELSE 0 END) FROM ways WHERE size < 50),
x AS (SELECT program, param, lag, steps, coalesce(plus, 0) AS plus, z, tests, CASE WHEN steps <= 50 AND steps = m AND tie = 1 THEN least(0.5, list_sum(list_slice(ways, 1, cast(coalesce(plus, 0) AS BIGINT) + 1)) / pow(2, steps), list_sum(list_slice(ways, cast(coalesce(plus, 0) AS BIGINT) + 1, len(ways))) / pow(2, steps)) END AS tail
FROM q JOIN c USING (program, param, lag) JOIN n USING (program) LEFT JOIN ways ON size = steps),
t AS (SELECT *, CASE WHEN tail IS NULL THEN z > {_CRITICAL} ELSE tail < {normal_cdf(-settle.SIGMA)!r} / tests END AS departs FROM x)
"""


def takes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Frames (take, frame, score) and the steps (take, param, frame) that changed what their parameter held."""
    e = events(spark, d).select(F.col("user_id").alias("take"), "t", "event_id", "event_type", "value").withColumn("_one", F.lit(1))
    placed = running(dealt(e, key=["take"], by="t"), key=["take"], order=["t", "event_id"], sums={"n": "_one"})
    placed = kept(placed.withColumn("place", F.col("n") - 1).withColumn("frame", F.expr("place div 2")))
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    scores = placed.groupBy("take", "frame").agg(F.when(F.count_if(F.col("event_type") == "signup") < 2, cents).alias("score"))
    wire = F.least(F.lit(7), F.floor(F.col("value") / 10)).cast("long")
    writes = placed.where("event_type in ('purchase', 'error')").select("take", F.when(F.col("event_type") == "purchase", 1).otherwise(2).alias("param"), "place", "frame", wire.alias("value"))
    return scores, settle.changed_steps(writes, key=["take"], order=["place"])


def _tests(spark: SparkSession, d: str) -> DataFrame:
    scores, steps = takes(spark, d)
    diffs = kept(settle.differences(scores, steps, key=["take"]).withColumn("program", F.col("take") % PROGRAMS))
    return settle.lag_tests(diffs, program=["program"])


@register(_SQL + "SELECT program, cast(param AS INTEGER) AS param, lag, steps, round(plus, 1) AS plus, CASE WHEN tail IS NULL THEN round(z, 6) END AS z, round(tail, 9) AS tail, departs FROM t")
def settle_lags(spark: SparkSession, d: str) -> DataFrame:
    """Each lag after the steps of a program, pooled and by parameter, tested against where the steps settled."""
    t = _tests(spark, d)
    return t.select("program", "param", "lag", "steps", F.round("plus", 1).alias("plus"), F.when(F.col("tail").isNull(), F.round("z", 6)).alias("z"), F.round("tail", 9).alias("tail"), "departs")


@register(_SQL + f""",
late AS (SELECT program, param, max(lag) AS late FROM (SELECT *, row_number() OVER (PARTITION BY program, param ORDER BY lag) AS k FROM t WHERE departs AND lag >= 2) WHERE lag = k + 1 GROUP BY 1, 2),
early AS (SELECT program, param, max(lag) AS early FROM t WHERE departs AND lag < 2 GROUP BY 1, 2),
u AS (SELECT program, max(coalesce(late, early)) AS moving FROM early LEFT JOIN late USING (program, param) GROUP BY 1),
v AS (SELECT program, max(tests) AS tests FROM t GROUP BY 1), g AS (SELECT program, tests, coalesce(moving, 0) AS settle FROM v LEFT JOIN u USING (program)),
y AS (SELECT g.program, settle, {_LEAST} AS least, coalesce(t.steps, 0) AS next_steps FROM g LEFT JOIN (SELECT program, lag, steps FROM t WHERE param = 0) t ON t.program = g.program AND t.lag = settle + 1)
SELECT program, settle, cast(least AS BIGINT) AS least, next_steps, next_steps >= least AS bounded, settle + 2 AS hold FROM y
""")
def program_settles(spark: SparkSession, d: str) -> DataFrame:
    """Frames that each program moves after a step, whether the next lag had steps enough to show it, and how long to hold."""
    return settle.settles(_tests(spark, d), program=["program"])
