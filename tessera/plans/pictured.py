"""Vectors as pictures of eight by eight: each label is a take, its vectors in order are the frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import pictures
from tessera.operators.windows import before, dealt
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6, table
from tessera.session import kept

SIDE, HOUR = 8, 3_600_000_000
_V = "WITH v AS (SELECT label, vec_id, unnest(cast(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS i FROM embeddings)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("label", F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("picture"))


@register(_V + """,
a AS (SELECT label, vec_id, embedding <> lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS new FROM embeddings), f AS (SELECT v.* FROM v JOIN a USING (label, vec_id) WHERE coalesce(new, true)),
s AS (SELECT label, vec_id, i, x - lag(x) OVER (PARTITION BY label, i ORDER BY vec_id) AS s FROM f), u AS (SELECT *, lag(s) OVER (PARTITION BY label, i ORDER BY vec_id) AS p FROM s),
c AS (SELECT label, vec_id, sum(s * p) / sqrt(sum(s * s) * sum(p * p)) AS c FROM u WHERE p IS NOT NULL GROUP BY 1, 2), m AS (SELECT label, avg(c) AS motion, stddev_samp(c) AS spread, count(*) AS turns FROM c GROUP BY 1),
g AS (SELECT label, i, avg(x) AS m, var_pop(x) * count(*) AS w, count(*) AS n FROM f GROUP BY 1, 2), l AS (SELECT label, max(n) AS n, count(*) AS px, sum(w) AS w, var_samp(m) AS b FROM g GROUP BY 1), k AS (SELECT label, count(*) AS frames FROM embeddings GROUP BY 1)
SELECT label, frames, n AS distinct, CASE WHEN n >= 4 THEN round(motion, 6) END AS motion, CASE WHEN n < 4 THEN true ELSE abs(motion + 0.5) <= 3 * spread / sqrt(turns) AND n * b * px * (n - 1) / w > 1 + 3 * sqrt(2.0 / (px - 1) + 2.0 / (px * (n - 1))) END AS still
FROM k JOIN l USING (label) LEFT JOIN m USING (label)
""")
def held_labels(spark: SparkSession, d: str) -> DataFrame:
    """Whether the vectors of a label are one picture held under noise."""
    found = pictures.held(_frames(spark, d), key=["label"])
    return found.select("label", "frames", "distinct", r6("motion").alias("motion"), "still")


@register(_V + """,
q AS (SELECT label, vec_id, i, x, lag(x) OVER w AS p, lead(x) OVER w AS n, row_number() OVER w - 2 AS at_frame FROM v WINDOW w AS (PARTITION BY label, i ORDER BY vec_id)),
t AS (SELECT *, 0.5 * CASE WHEN vec_id % 5 = 0 AND i < 24 THEN p ELSE x END + 0.1 AS y FROM q WHERE p IS NOT NULL AND n IS NOT NULL),
l AS (SELECT label, regr_slope(y, x) AS gain, regr_intercept(y, x) AS base FROM t WHERE (at_frame * 64 + i) % 7 = 0 GROUP BY 1),
b AS (SELECT label, vec_id, i // 24 AS band, avg(abs(y - (gain * x + base))) AS own, least(avg(abs(y - (gain * p + base))), avg(abs(y - (gain * n + base)))) AS near, least(avg(abs(gain * (x - p))), avg(abs(gain * (x - n)))) AS apart FROM t JOIN l USING (label) WHERE i < 40 GROUP BY 1, 2, 3)
SELECT label, round(any_value(gain), 6) AS gain, round(any_value(base), 6) AS "offset", count(*) FILTER (apart > least(own, near)) AS judged, count(*) FILTER (apart > least(own, near) AND near < own) AS torn FROM b JOIN l USING (label) GROUP BY 1
""")
def torn_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands of a label's pictures that show a neighbouring frame; every fifth vector's upper rows are those of the one before."""
    ranged = kept(dealt(_frames(spark, d), key=["label"], by="frame"))
    rows = before(ranged, key=["label"], order=["frame"], value="picture", name="_was").drop("_range")
    mixed = F.when(F.col("frame") % 5 == 0, F.concat(F.slice(F.coalesce("_was", "picture"), 1, 24), F.slice("picture", 25, 40))).otherwise(F.col("picture"))
    frames = rows.select("label", "frame", F.transform(mixed, lambda x: 0.5 * x + 0.1).alias("captured"), F.col("picture").alias("source"))
    found = pictures.tears(frames, key=["label"], width=SIDE, height=SIDE)
    return found.select("label", r6("gain").alias("gain"), r6("offset").alias("offset"), "judged", "torn")


@register(f"""
WITH w AS (SELECT user_id, event_id, event_type, epoch_us(ts) // {HOUR} - min(epoch_us(ts) // {HOUR}) OVER (PARTITION BY user_id) AS target FROM events)
SELECT user_id, event_id, event_type, CASE WHEN target > 0 THEN min(target) FILTER (target > 0) OVER (PARTITION BY user_id, event_type) + count(*) FILTER (target > 0) OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 ELSE 0 END AS target FROM w
""")
def restaggered_writes(spark: SparkSession, d: str) -> DataFrame:
    """A user's events aimed at hours after its first, those of a type spread one an hour from where they start."""
    e = events(spark, d).select("user_id", "event_id", "event_type", F.expr(f"t div {HOUR}").alias("_h"))
    first = e.groupBy("user_id").agg(F.min("_h").alias("_first"))
    plan = e.join(first, "user_id").select("user_id", "event_id", "event_type", (F.col("_h") - F.col("_first")).alias("target"))
    return pictures.restaggered(plan, key=["user_id"], owner="event_type", order="event_id")
