"""Sections of the labels' vector series, and phrases of users' sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import sections as s
from tessera.plans.catalogue import register
from tessera.plans.tables import events, table


@register()
def label_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of each label's vectors in order of id, cut at prominent novelty peaks and classed by likeness."""
    return s.sections(table(spark, d, "embeddings"), key="label", order="vec_id", vector="embedding")


@register("""
WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t FROM events),
s AS (SELECT user_id, event_id AS section, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM e WHERE event_type = 'signup'),
m AS (SELECT user_id, t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM e WHERE event_type = 'view') WHERE k % 2 = 1),
c AS (SELECT user_id, section, a, b, a AS cut FROM s WHERE b IS NOT NULL UNION SELECT s.user_id, section, a, b, m.t FROM s JOIN m ON m.user_id = s.user_id AND m.t > s.a AND m.t < s.b)
SELECT user_id, section, row_number() OVER w - 1 AS piece, cut AS a, coalesce(lead(cut) OVER w, b) AS b FROM c WINDOW w AS (PARTITION BY user_id, section ORDER BY cut)
""")
def section_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Sections between a user's signups, split at every second view inside them."""
    e = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("section"), F.col("t").alias("a"), F.lead("t").over(w).alias("b")).where("b is not null")
    marks = e.where("event_type = 'view'").select("user_id", "t", F.row_number().over(w).alias("k")).where("k % 2 = 1").select("user_id", "t")
    made = s.phrases(spans, marks, key=["user_id"], start="a", end="b", at="t", width=2 * 86_400_000_000)
    return made.withColumn("piece", F.col("piece").cast("long"))
