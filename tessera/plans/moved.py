"""Steps and what they moved: each user is a take, each event a frame, purchases and errors are the steps of two parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import moves
from tessera.operators.windows import dealt, running
from tessera.plans.catalogue import register
from tessera.plans.tables import events

SPANS = [1, 2]
_FRAMES = """
WITH f AS (SELECT user_id AS take, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type, event_id, value FROM events),
s AS (SELECT take, CASE event_type WHEN 'purchase' THEN 1 ELSE 2 END AS param, frame, cast(1 + event_id % 2 AS INTEGER) AS span, frame - event_id % 2 AS first, CASE WHEN event_id % 7 = 0 THEN 'unchanged' WHEN value >= 10 THEN 'live' ELSE 'noop' END AS verdict FROM f WHERE event_type IN ('purchase', 'error'))
"""


def takes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Frames (take, frame, out, src) and steps (take, param, frame, span, verdict) of the events."""
    e = events(spark, d).select(F.col("user_id").alias("take"), "t", "event_id", "event_type", "value").withColumn("_one", F.lit(1))
    f = running(dealt(e, key=["take"], by="t"), key=["take"], order=["t", "event_id"], sums={"n": "_one"}).withColumn("frame", F.col("n") - 1)
    verdict = F.when(F.col("event_id") % 7 == 0, "unchanged").when(F.col("value") >= 10, moves.LIVE).otherwise(moves.NOOP)
    steps = f.where("event_type in ('purchase', 'error')").select("take", F.when(F.col("event_type") == "purchase", 1).otherwise(2).alias("param"), "frame", (1 + F.col("event_id") % 2).cast("int").alias("span"), verdict.alias("verdict"))
    return f.select("take", "frame", F.col("value").alias("out"), (F.col("t") / 3.6e9).alias("src")), steps


@register(_FRAMES + """
, live AS (SELECT DISTINCT take, param, first, frame, span FROM s WHERE verdict = 'live'), noop AS (SELECT DISTINCT take, param, first, frame, span FROM s WHERE verdict = 'noop'),
quiet AS (SELECT * FROM noop n WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.take = n.take AND l.first - 1 <= n.frame AND l.frame + 1 >= n.first)),
p AS (SELECT 'live' AS pool, * FROM live UNION ALL SELECT 'dead', * FROM quiet), r AS (SELECT 'live' AS pool, * FROM live UNION ALL SELECT 'dead', * FROM live UNION ALL SELECT 'dead', * FROM noop),
a AS (SELECT p.*, NOT EXISTS (SELECT 1 FROM r WHERE r.pool = p.pool AND r.take = p.take AND r.param <> p.param AND r.first <= p.frame AND r.frame >= p.first) AS free FROM p)
SELECT take, param, pool, frame, span, free OR NOT bool_or(free) OVER (PARTITION BY take, param, pool) AS alone,
CASE WHEN NOT bool_or(free) OVER (PARTITION BY take, param, pool) THEN '[' || cast(3 - param AS VARCHAR) || ']' END AS partners FROM a
""")
def step_pools(spark: SparkSession, d: str) -> DataFrame:
    """Every user's steps in pools: live ones and proven no-ops apart from them, alone or with the partners they land with."""
    _, steps = takes(spark, d)
    return moves.step_pools(steps, reach=1).withColumn("partners", F.col("partners").cast("string"))


@register()
def acted_upon(spark: SparkSession, d: str) -> DataFrame:
    """Which pools of a user's steps moved the values, against matched step-free events of the user, over all tests together."""
    frames, steps = takes(spark, d)
    made = moves.acted_upon(frames, steps, spans=SPANS, quantum=0.01)
    return made.withColumn("partners", F.col("partners").cast("string"))
