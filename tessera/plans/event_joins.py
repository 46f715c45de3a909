"""Attribution and evidence queries: joins over event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import joins, robust, windows
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6, table

HOUR = 3_600_000_000


@register("""
WITH e AS (SELECT * FROM events), s AS (SELECT user_id, ts, event_id FROM e WHERE event_type = 'signup'),
o AS (SELECT user_id, ts, event_type, value FROM e WHERE event_type <> 'signup'),
j AS (SELECT o.event_type, o.value FROM o ASOF JOIN s ON o.user_id = s.user_id AND o.ts > s.ts),
m AS (SELECT event_type, count(value) AS n, median(value) AS median, stddev_pop(value) AS sd FROM j GROUP BY 1),
d AS (SELECT j.event_type, median(abs(j.value - m.median)) AS mad FROM j JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, n, round(median, 6) AS median, round(CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd ELSE 1 END, 6) AS scale FROM m JOIN d USING (event_type)
""")
def setpoint_response(spark: SparkSession, d: str) -> DataFrame:
    """Events attributed to the state (signup) that held, with a robust response per type."""
    e = events(spark, d)
    held = joins.asof(e.where("event_type <> 'signup'"), e.where("event_type = 'signup'"), key=["user_id"], time="t", values=["event_id"], tie="event_id")
    fit = robust.robust_scale(held.where("r_event_id is not null"), key=["event_type"], value="value", dealt=False)
    return fit.select("event_type", "n", r6("median").alias("median"), r6("scale").alias("scale"))


def _asof_sql(op: str) -> str:
    return f"""
SELECT p.event_id, c.event_id AS click_id, round(c.value, 6) AS click_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts {op} c.ts
"""


def _asof(spark: SparkSession, d: str, **options) -> DataFrame:
    found = joins.asof(events(spark, d, "purchase"), events(spark, d, "click").withColumn("id", F.col("event_id")), key=["user_id"], time="t", values=["id", "value"], tie="event_id", **options)
    return found.select("event_id", F.col("r_id").alias("click_id"), r6("r_value").alias("click_value"))


@register(_asof_sql(">"))
def asof_backward_strict(spark: SparkSession, d: str) -> DataFrame:
    """Last click before each purchase."""
    return _asof(spark, d)


@register(_asof_sql(">="))
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    """Last click at or before each purchase."""
    return _asof(spark, d, strict=False)


@register(_asof_sql("<"))
def asof_forward_strict(spark: SparkSession, d: str) -> DataFrame:
    """First click after each purchase."""
    return _asof(spark, d, forward=True)


@register(_asof_sql("<="))
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    """First click at or after each purchase."""
    return _asof(spark, d, forward=True, strict=False)


@register("""
WITH e AS (SELECT user_id, event_type, value, epoch_us(ts) AS t FROM events),
w AS (SELECT user_id, t - 3600000000 AS a, t + 7200000000 AS b, value AS goal FROM e WHERE event_type = 'purchase')
SELECT w.user_id, e.event_type, count(*) AS n, round(sum(e.value), 4) AS total
FROM e JOIN w ON e.user_id = w.user_id AND e.t BETWEEN w.a AND w.b GROUP BY 1, 2
""")
def interval_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Events inside the window around each purchase of their user."""
    e = events(spark, d)
    spans = e.where("event_type = 'purchase'").select("user_id", (F.col("t") - HOUR).alias("a"), (F.col("t") + 2 * HOUR).alias("b"))
    found = joins.interval_join(e, spans, time="t", start="a", end="b", width=3 * HOUR, key=["user_id"])
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("""
WITH c AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'click'),
p AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase')
SELECT user_id, count(*) FILTER (p.k IS NULL) AS missing, count(*) FILTER (c.k IS NULL) AS extra, count(*) FILTER (p.ts > c.ts) AS late, count(*) FILTER (p.ts < c.ts) AS early
FROM c FULL JOIN p USING (user_id, k) GROUP BY 1
""")
def ordinal_match(spark: SparkSession, d: str) -> DataFrame:
    """The k-th click of a user against the k-th purchase: missing, extra, late and early ones."""
    c = events(spark, d, "click").select("user_id", F.col("t").alias("ct"), F.col("event_id").alias("ce"))
    p = events(spark, d, "purchase").select("user_id", F.col("t").alias("pt"), F.col("event_id").alias("pe"))
    m = joins.ordinal_join(c, p, key=["user_id"], order_a=["ct", "ce"], order_b=["pt", "pe"])
    return m.groupBy("user_id").agg(F.count_if(F.col("pe").isNull()).alias("missing"), F.count_if(F.col("ce").isNull()).alias("extra"), F.count_if(F.col("pt") > F.col("ct")).alias("late"), F.count_if(F.col("pt") < F.col("ct")).alias("early"))


@register("""
WITH w AS (SELECT event_type, epoch_us(ts) AS t, event_id, value FROM events),
g AS (SELECT event_type, unnest(range(min(t) // 3600000000, max(t) // 3600000000 + 1)) * 3600000000 AS t FROM w GROUP BY 1)
SELECT g.event_type, g.t, round(coalesce(w.value, 511), 6) AS held FROM g ASOF LEFT JOIN w ON g.event_type = w.event_type AND g.t >= w.t
""")
def zero_order_hold(spark: SparkSession, d: str) -> DataFrame:
    """Latest value of each event type on an hourly grid, 511 before the first."""
    w = events(spark, d)
    grid = w.groupBy("event_type").agg(F.floor(F.min("t") / HOUR).alias("a"), F.floor(F.max("t") / HOUR).alias("b")).select("event_type", F.explode(F.transform(F.sequence("a", "b"), lambda h: h * HOUR)).alias("t"))
    held = joins.hold(w, grid, key=["event_type"], time="t", value="value", tie="event_id", default=F.lit(511.0))
    return held.select("event_type", "t", r6("r_value").alias("held"))


@register("""
WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events), x AS (SELECT * FROM e WHERE event_type = 'error')
SELECT x.event_id, coalesce(bool_or(floor(e.value) = floor(x.value)), false) AS explained, count(e.event_id) AS candidates
FROM x LEFT JOIN e ON e.user_id = x.user_id AND e.event_type <> 'error' AND e.t BETWEEN x.t - 3600000000 AND x.t + 3600000000 GROUP BY 1
""")
def temporal_validity(spark: SparkSession, d: str) -> DataFrame:
    """Does any value held within an hour of an error explain the error's value?"""
    x = events(spark, d, "error").select("event_id", "user_id", F.col("value").alias("want"), (F.col("t") - HOUR).alias("a"), (F.col("t") + HOUR).alias("b"))
    others = events(spark, d, "click", "purchase", "signup", "view").select("user_id", "value", "t")
    hits = joins.interval_join(others, x, time="t", start="a", end="b", width=2 * HOUR, key=["user_id"])
    found = hits.groupBy("event_id").agg(F.bool_or(F.floor("value") == F.floor("want")).alias("explained"), F.count("*").alias("candidates"))
    return x.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("explained", F.lit(False)).alias("explained"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


@register("""
WITH e AS (SELECT event_id, user_id, value, epoch_us(ts) AS t FROM events),
g AS (SELECT DISTINCT user_id, (t // 3600000000) * 3600000000 + 1800000000 AS centre FROM e),
j AS (SELECT g.user_id, g.centre, e.event_id, row_number() OVER (PARTITION BY g.user_id, g.centre ORDER BY abs(e.t - g.centre), e.t DESC, e.event_id DESC) AS k
FROM g JOIN e ON e.user_id = g.user_id AND e.t BETWEEN g.centre - 1800000000 AND g.centre + 1800000000)
SELECT user_id, centre, event_id FROM j WHERE k = 1
""")
def nearest_pick(spark: SparkSession, d: str) -> DataFrame:
    """The event nearest the middle of each hour of a user."""
    e = events(spark, d)
    centres = e.select("user_id", (F.floor(F.col("t") / HOUR) * HOUR + HOUR // 2).alias("centre")).distinct()
    return joins.nearest(centres, e.select("user_id", "t", "event_id"), key=["user_id"], at="centre", time="t", tie="event_id", reach=HOUR // 2).select("user_id", "centre", "event_id")


@register("""
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events), s AS (SELECT user_id, t AS a, t + 3600000000 AS b FROM e WHERE event_type = 'signup')
SELECT event_id, event_type FROM e WHERE event_type <> 'signup' AND EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND e.t >= s.a AND e.t <= s.b)
""")
def semi_spans(spark: SparkSession, d: str) -> DataFrame:
    """Events inside the hour after a signup of their user."""
    e = events(spark, d)
    spans = e.where("event_type = 'signup'").select("user_id", F.col("t").alias("a"), (F.col("t") + HOUR).alias("b"))
    return joins.interval_join(e.where("event_type <> 'signup'"), spans, time="t", start="a", end="b", width=HOUR, key=["user_id"], how="left_semi").select("event_id", "event_type")


@register("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def anti_pending(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order in progress: what is still pending."""
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@register("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), s AS (SELECT user_id, t AS a, t + 21600000000 AS b FROM e),
m AS (SELECT user_id, pt, sum(d) AS d FROM (SELECT user_id, a AS pt, 1 AS d FROM s UNION ALL SELECT user_id, b, -1 FROM s) GROUP BY 1, 2),
c AS (SELECT user_id, pt AS f, lead(pt) OVER w AS u, sum(d) OVER (PARTITION BY user_id ORDER BY pt ROWS UNBOUNDED PRECEDING) AS cover FROM m WINDOW w AS (PARTITION BY user_id ORDER BY pt))
SELECT user_id, cast(max(cover) AS BIGINT) AS most, cast(sum(u - f) AS BIGINT) AS covered, cast(sum((u - f) * cover) AS BIGINT) AS weight FROM c WHERE u IS NOT NULL AND cover > 0 GROUP BY 1
""")
def sweep_cover(spark: SparkSession, d: str) -> DataFrame:
    """How deep six-hour activity windows of a user overlap, and for how long."""
    spans = events(spark, d).select("user_id", F.col("t").alias("a"), (F.col("t") + 6 * HOUR).alias("b"))
    c = windows.sweep_cover(spans, key=["user_id"], start="a", end="b")
    length = F.col("to") - F.col("from")
    return c.groupBy("user_id").agg(F.max("cover").alias("most"), F.sum(length).alias("covered"), F.sum(length * F.col("cover")).alias("weight"))


@register("""
WITH p AS (SELECT p_partkey, p_size, p_retailprice FROM part),
n AS (SELECT a.p_partkey, a.p_retailprice AS own, b.p_retailprice AS other, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_retailprice - b.p_retailprice), b.p_partkey) AS k
FROM p a JOIN p b ON a.p_size = b.p_size AND a.p_partkey <> b.p_partkey)
SELECT p_partkey, round(own - avg(other), 6) AS residual FROM n WHERE k <= 5 GROUP BY p_partkey, own
""")
def knn_matched(spark: SparkSession, d: str) -> DataFrame:
    """Price of each part against the mean of the five parts of its size that are nearest in price, of equally near ones those with the smallest keys.

    In order of distinct prices the k nearest lie within k prices on either side, and of a price its k smallest keys can be among
    them, k + 1 with the part's own. So a window of prices holds them, however many parts share one. Null prices come last.
    """
    k = 5
    own = F.col("p_retailprice")
    p = table(spark, d, "part").select("p_partkey", "p_size", own).where("p_size is not null and p_partkey is not null")
    first = p.withColumn("n", F.row_number().over(Window.partitionBy("p_size", own).orderBy("p_partkey"))).where(F.col("n") <= k + 1)
    prices = first.groupBy("p_size", own).agg(F.collect_list("p_partkey").alias("ids"))
    around = F.collect_list(F.struct(own.alias("v"), "ids")).over(Window.partitionBy("p_size").orderBy(own).rowsBetween(-k, k))
    place = lambda v, i: F.struct(v.isNull().alias("last"), F.abs(v - own).alias("o"), i.alias("id"), v.alias("v"))
    near = F.flatten(F.transform("around", lambda g: F.transform(g["ids"], lambda i: place(g["v"], i))))
    closest = prices.withColumn("around", around).select("p_size", own.alias("price"), F.slice(F.array_sort(near), 1, k + 1).alias("near"))
    # as merge: a file that looks small would send all parts through the driver
    ranked = p.hint("merge").join(closest.withColumnRenamed("p_size", "size"), (F.col("size") == F.col("p_size")) & F.col("price").eqNullSafe(own))
    others = ranked.select("p_partkey", own, F.slice(F.filter("near", lambda x: x["id"] != F.col("p_partkey")), 1, k).alias("near")).where(F.size("near") > 0)
    priced = F.filter("near", lambda x: x["v"].isNotNull())
    mean = F.aggregate(priced, F.lit(0.0), lambda a, x: a + x["v"]) / F.nullif(F.size(priced), F.lit(0))
    return others.select("p_partkey", r6(own - mean).alias("residual"))
