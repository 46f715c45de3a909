"""Measurement rows, response curves, spectra of uneven series, alignment and rhythm."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import arrays
from tessera.functions import exprs as x
from tessera.operators import series
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6, table
from tessera.sources import store

HOUR = 3_600_000_000


@register("SELECT l_orderkey AS state_index, l_returnflag AS program, cast(l_quantity AS INT) AS p1, l_linenumber AS p2, l_discount AS discount, CASE WHEN l_tax > 0.04 THEN l_tax END AS tax FROM lineitem")
def measurement_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines as measurement records with open metrics, narrowed to maps and widened again."""
    li = table(spark, d, "lineitem")
    rows = li.select(
        F.col("l_returnflag").alias("program"), F.lit("1").alias("firmware"), F.lit("frames").alias("analyzer"), F.lit("hw").alias("source"), F.col("l_orderkey").alias("state_index"), F.lit("clip").alias("stimulus"), F.lit(2).alias("settle_frames"),
        *[c.alias(p) for p, c in zip(store.PARAMS, [F.col("l_quantity").cast("int"), F.col("l_linenumber"), *[F.lit(0)] * 10])],
        F.col("l_discount").alias("discount"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("tax"),
    )
    return store.wide(store.narrow(rows), ["discount", "tax"]).select("state_index", "program", "p1", "p2", "discount", "tax")


@register("""
WITH u AS (SELECT p_partkey, p_size / 50.0 AS u FROM part)
SELECT p_partkey, round(u * u, 9) AS quad_in, round(1 - (1 - u) * (1 - u), 9) AS quad_out, round(1 - sqrt(greatest(0, 1 - u * u)), 9) AS circ_in, round(u ** 5, 9) AS quint_in, round(CASE WHEN u <= 0 THEN 0 ELSE 2 ** ((u - 1) * 10) END, 9) AS expo_in, round(floor(least(u, 1 - 1e-12) * 4) / 3, 9) AS steps4,
round(CASE WHEN u < 0.25 THEN 2.0 ELSE 2.0 + (u - 0.25) / 0.75 * 28.0 END, 6) AS usable, round(round_even(u * 7, 0) / 7, 9) AS snapped FROM u
""")
def response_curves(spark: SparkSession, d: str) -> DataFrame:
    """Control curves, usable rates and level snaps over part sizes."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / F.lit(50.0)).alias("u"))
    u = F.col("u")
    return p.select("p_partkey", *[F.round(x.response_curve(u, m), 9).alias(m) for m in ("quad_in", "quad_out", "circ_in", "quint_in", "expo_in", "steps4")], r6(x.usable_rate(u, 0.25, 2.0, 30.0)).alias("usable"), F.round(x.snap_levels(u, 8), 9).alias("snapped"))


@register("""
WITH c AS (SELECT user_id, count(*) AS n, corr(value, epoch_us(ts) / 1e6) AS r FROM events GROUP BY 1)
SELECT user_id, n, round(CASE WHEN n > 3 AND abs(r) < 1 THEN atanh(r) * sqrt(n - 3) ELSE 0 END, 4) AS z FROM c
""")
def follow_z(spark: SparkSession, d: str) -> DataFrame:
    """Fisher z of each user's drift over time."""
    c = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.corr("value", F.col("t") / 1e6).alias("r"))
    return c.select("user_id", "n", F.round(x.follow_z(F.col("r"), F.col("n")), 4).alias("z"))


_GRID = [k / 4 for k in range(1, 33)]


@register("""
WITH e AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS v, (epoch_us(ts) % 2592000000000) / 86400000000.0 AS t FROM events), f AS (SELECT unnest(range(1, 33)) / 4.0 AS f),
p AS (SELECT event_type, f, (sum(v * cos(2 * pi() * f * t)) ** 2 + sum(v * sin(2 * pi() * f * t)) ** 2) / count(*) AS p FROM e, f GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p DESC) AS k FROM p)
SELECT event_type, f AS rate, round(p, 4) AS power FROM k WHERE k = 1
""")
def uneven_rate(spark: SparkSession, d: str) -> DataFrame:
    """Strongest of a grid of daily rates in each type's uneven series; every rate is a sum in one pass."""
    e = events(spark, d).withColumn("v", F.col("value") - F.avg("value").over(Window.partitionBy("event_type"))).withColumn("day", (F.col("t") % 2_592_000_000_000) / F.lit(86_400_000_000.0))
    angle = lambda f: F.col("day") * F.lit(2 * math.pi * f)
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), *[g(F.col("v") * h(angle(f))).alias(f"{c}{i}") for i, f in enumerate(_GRID) for c, g, h in (("c", F.sum, F.cos), ("s", F.sum, F.sin))])
    power = F.array(*[F.struct(((F.col(f"c{i}") ** 2 + F.col(f"s{i}") ** 2) / F.col("n")).alias("p"), F.lit(f).alias("f")) for i, f in enumerate(_GRID)])
    return sums.select("event_type", F.array_max(power).alias("b")).select("event_type", F.col("b.f").alias("rate"), F.round("b.p", 4).alias("power"))


@register("""
WITH s AS (SELECT l_returnflag AS g, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS byy, stddev_pop(l_extendedprice) AS sy FROM lineitem GROUP BY 1)
SELECT g AS l_returnflag, round((ay * bb - byy * ab) / (aa * bb - ab * ab) * sqrt(aa) / sy, 6) AS quantity, round((byy * aa - ay * ab) / (aa * bb - ab * ab) * sqrt(bb) / sy, 6) AS discount FROM s
""")
def regression_effects(spark: SparkSession, d: str) -> DataFrame:
    """Standardised least-squares effects of two settings at once, from covariances in one pass."""
    q, c, y = "l_quantity", "l_discount", "l_extendedprice"
    s = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.var_pop(q).alias("aa"), F.var_pop(c).alias("bb"), F.covar_pop(q, c).alias("ab"), F.covar_pop(q, y).alias("ay"), F.covar_pop(c, y).alias("cy"), F.stddev_pop(y).alias("sy"))
    det = F.expr("aa * bb - ab * ab")
    return s.select("l_returnflag", r6(F.expr("ay * bb - cy * ab") / det * F.sqrt("aa") / F.col("sy")).alias("quantity"), r6(F.expr("cy * aa - ay * ab") / det * F.sqrt("bb") / F.col("sy")).alias("discount"))


@register()
def aligned_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Each user's event types of the first half of the month aligned with those of the second, by longest blocks."""
    day = F.floor(F.col("t") / (24 * HOUR))
    e = events(spark, d).withColumn("late", (day % 30) >= 15)
    half = lambda late: F.transform(F.array_sort(F.collect_list(F.when(F.col("late") == late, F.struct("t", "event_id", "event_type")))), lambda z: z["event_type"])
    s = e.groupBy("user_id").agg(half(False).alias("a"), half(True).alias("b"))

    def blocks(a: pa.Array, b: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32()), ("size", pa.int32())]))
        return pa.array([[{"at": i, "to": j, "size": n} for i, j, n in arrays.matching_blocks(u.as_py(), v.as_py(), 2)] for u, v in zip(a, b)], kind)

    find = F.arrow_udf(lambda a, b: blocks(a, b), "array<struct<at: int, to: int, size: int>>")
    return s.select("user_id", F.explode(find("a", "b")).alias("m")).select("user_id", "m.*")


@register()
def series_rhythm(spark: SparkSession, d: str) -> DataFrame:
    """Period, beats and strength of each user's six-hour value series."""
    s = events(spark, d).groupBy("user_id", F.floor(F.col("t") / (6 * HOUR)).alias("h")).agg(F.sum("value").alias("v"))
    rows = s.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "v"))), lambda z: z["v"]).alias("x"))
    m = arrays.array_metric(arrays.onsets, ["period", "beats", "strength"])
    return rows.select("user_id", m(F.col("x")).alias("m")).select("user_id", "m.*")


def _novelty_sql(half: int = 4) -> str:
    weight = [(-1.0 if k < half else 1.0) * math.exp(-(((k - half + 0.5) / half) ** 2)) for k in range(2 * half)]
    at = lambda k: f"lag(u, {half - k}, 0.0) OVER w" if k < half else f"lead(u, {k - half}, 0.0) OVER w"
    total = " + ".join(f"({v!r}) * {at(k)}" for k, v in enumerate(weight))
    return f"""
WITH v AS (SELECT label, vec_id, unnest(cast(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings), n AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM v GROUP BY 1),
u AS (SELECT label, v.vec_id, i, x / n AS u FROM v JOIN n USING (vec_id)), t AS (SELECT label, vec_id, {total} AS t FROM u WINDOW w AS (PARTITION BY label, i ORDER BY vec_id)), s AS (SELECT label, vec_id, sum(t * t) AS s FROM t GROUP BY 1, 2)
SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, round(s, 6) AS novelty FROM s
"""


@register(_novelty_sql())
def label_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Novelty at each vector of a label, in order of id, along the similarity matrix of all its vectors."""
    found = series.checkerboard_novelty(table(spark, d, "embeddings"), key="label", order="vec_id", vector="embedding")
    return found.withColumn("novelty", r6("novelty"))
