"""Programs assigned to a score's runs, and automation gated on liveness: users are scores, their days are runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import assign as a
from tessera.plans.catalogue import register
from tessera.plans.tables import events

DAY = 86_400_000_000
PROGRAMS = {"view": 0.2, "click": 0.35, "signup": 0.5, "purchase": 0.65, "error": 0.8}
PARAMS = {"view": 1, "click": 2, "signup": 3, "purchase": 4, "error": 5}
#: purchases are live while view is 20 or more; errors while view is under 20 and signup 30 or more
LIVE = {4: [(1, 20, 1023)], 5: [(1, 0, 19), (3, 30, 1023)]}
REVIVALS = {4: [[(1, 1023)]], 5: [[(1, 0)]]}

_COSTS = f"""
WITH q AS (SELECT event_type, CASE event_type {' '.join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PROGRAMS))} END AS place, CASE event_type {' '.join(f"WHEN '{p}' THEN quantile_cont(value, {x})" for p, x in PROGRAMS.items())} END AS level FROM events GROUP BY 1),
r AS (SELECT user_id, epoch_us(ts) // {DAY} AS run, avg(value) AS target FROM events GROUP BY 1, 2),
c AS (SELECT user_id, run, row_number() OVER (PARTITION BY user_id, place ORDER BY run) AS k, count(*) OVER (PARTITION BY user_id, place) AS n, place, event_type, round(abs(target - level) * 1e6) AS cost FROM r CROSS JOIN q)
"""


def costs(spark: SparkSession, d: str) -> DataFrame:
    """user_id, run (day), program and cost: how far the day's mean lies from the program's level, in millionths."""
    e = events(spark, d)
    programs = e.where(F.col("event_type").isin(*PROGRAMS)).groupBy("event_type").agg(*[F.percentile("value", F.lit(x)).alias(p) for p, x in PROGRAMS.items()])
    own = programs.select(F.col("event_type").alias("program"), F.coalesce(*[F.when(F.col("event_type") == p, F.col(p)) for p in PROGRAMS]).alias("level"))
    days = e.groupBy("user_id", F.floor(F.col("t") / DAY).alias("run")).agg(F.avg("value").alias("target"))
    # one row a program, by the list above
    return days.join(F.broadcast(own)).select("user_id", "run", "program", F.round(F.abs(F.col("target") - F.col("level")) * 1e6).alias("cost"))


def _assigned(spark: SparkSession, d: str, passes: int | None) -> DataFrame:
    made = a.assign(costs(spark, d), key="user_id", run="run", state="program", cost="cost", states=list(PROGRAMS), passes=passes)
    return made.select("user_id", "run", "program", F.col("step_cost").cast("long").alias("step_cost"), F.col("total").cast("long").alias("total"))


@register(_COSTS + """,
f AS (SELECT user_id, arg_min(place, (s, place)) AS a FROM (SELECT user_id, place, sum(cost) AS s FROM c GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT c.user_id, f.a, o.place AS b, sum(CASE WHEN (c.n - c.k) % 2 = 0 THEN c.cost ELSE o.cost END) AS ends_a, sum(CASE WHEN (c.n - c.k) % 2 = 0 THEN o.cost ELSE c.cost END) AS ends_b FROM c JOIN f ON f.user_id = c.user_id AND f.a = c.place JOIN c o ON o.user_id = c.user_id AND o.run = c.run AND o.place <> f.a GROUP BY 1, 2, 3),
w AS (SELECT user_id, any_value(a) AS a, arg_min(b, (least(ends_a, ends_b), b)) AS b, arg_min(ends_a <= ends_b, (least(ends_a, ends_b), b)) AS first, min(least(ends_a, ends_b)) AS total FROM x GROUP BY 1)
SELECT c.user_id, run, event_type AS program, cast(cost AS BIGINT) AS step_cost, cast(total AS BIGINT) AS total FROM c JOIN w ON w.user_id = c.user_id AND c.place = CASE WHEN ((c.n - c.k) % 2 = 0) = w.first THEN w.a ELSE w.b END
""")
def assign_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two programs for each user's days, chosen one after the other, never the same one on two days running."""
    return _assigned(spark, d, 2)


@register()
def assign_programs(spark: SparkSession, d: str) -> DataFrame:
    """Three programs for each user's days, chosen one after the other."""
    return _assigned(spark, d, 3)


@register("""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS p, least(cast(floor(value) AS BIGINT), 1023) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (
SELECT user_id, cast(0 AS BIGINT) AS event_id, 0 AS p, cast(0 AS BIGINT) AS v, cast(0 AS BIGINT) AS i, 0 AS code, cast(0 AS BIGINT) AS s1, cast(0 AS BIGINT) AS s2, cast(0 AS BIGINT) AS s3, cast(0 AS BIGINT) AS s4, cast(0 AS BIGINT) AS s5 FROM (SELECT DISTINCT user_id FROM e)
UNION ALL
SELECT user_id, event_id, p, v, i, code, CASE WHEN code = 1 THEN CASE p WHEN 4 THEN 1023 ELSE 0 END WHEN p = 1 AND code = 0 THEN v ELSE s1 END, CASE WHEN p = 2 AND code >= 0 THEN v ELSE s2 END, CASE WHEN p = 3 AND code >= 0 THEN v ELSE s3 END, CASE WHEN p = 4 AND code >= 0 THEN v ELSE s4 END, CASE WHEN p = 5 AND code >= 0 THEN v ELSE s5 END
FROM (SELECT e.user_id, e.event_id, e.p, e.v, e.i, f.s1, f.s2, f.s3, f.s4, f.s5, CASE WHEN e.p < 4 OR e.v = CASE e.p WHEN 4 THEN f.s4 ELSE f.s5 END THEN 0 WHEN e.p = 4 THEN CASE WHEN f.s1 >= 20 THEN 0 ELSE 1 END WHEN f.s3 < 30 THEN -1 WHEN f.s1 < 20 THEN 0 ELSE 1 END AS code FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
)
SELECT user_id, event_id, cast(CASE WHEN code = 1 THEN 1 ELSE 0 END AS INTEGER) AS place, cast(p AS INTEGER) AS param, v AS value, code = 1 AS paired FROM f WHERE i > 0 AND code >= 0
UNION ALL SELECT user_id, event_id, 0, 1, CASE p WHEN 4 THEN 1023 ELSE 0 END, true FROM f WHERE code = 1
""")
def gated_automation(spark: SparkSession, d: str) -> DataFrame:
    """Each user's writes gated on liveness: dead ones are paired with the move that revives them, or refused."""
    p = F.lit(None).cast("int")
    for name, number in PARAMS.items():
        p = F.when(F.col("event_type") == name, number).otherwise(p)
    w = events(spark, d).select("user_id", "t", "event_id", p.alias("p"), F.least(F.floor("value"), F.lit(1023)).alias("v"))
    made = a.gate_writes(w, key="user_id", time="t", tie="event_id", param="p", value="v", live=LIVE, revivals=REVIVALS)
    return made.select("user_id", "event_id", "place", "param", "value", "paired")
