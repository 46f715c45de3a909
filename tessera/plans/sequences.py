"""Window, fold and series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import folds, series, windows
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6, table

HOUR = 3_600_000_000
_E = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events)"


@register(_E + """,
m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, cast(island AS BIGINT) AS island, event_type, count(*) AS length, min(t) AS first, max(t) AS last FROM i GROUP BY 1, 2, 3
""")
def islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one event type."""
    return windows.runs(events(spark, d), key=["user_id"], order=["t", "event_id"], same="event_type")


@register(_E + """,
m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m),
r AS (SELECT user_id, island, event_type, count(*) AS length, min(t) AS first, max(t) AS last FROM i GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, island) AS k FROM r)
SELECT user_id, event_type, length, first, last FROM k WHERE k = 1
""")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    """Longest run of one event type of each user, the first on a tie."""
    return windows.longest_run(events(spark, d), key=["user_id"], order=["t", "event_id"], same="event_type")


@register(_E + """,
m AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) = event_type THEN 0 ELSE 1 END AS n FROM e)
SELECT event_id, user_id, event_type FROM m WHERE n = 1
""")
def run_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First event of every run: what a run-length store keeps."""
    marked = windows.islands(events(spark, d), key=["user_id"], order=["t", "event_id"], same="event_type")
    first = F.row_number().over(Window.partitionBy("user_id", "island").orderBy("t", "event_id"))
    return marked.withColumn("k", first).where("k = 1").select("event_id", "user_id", "event_type")


@register(_E + """,
g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e), m AS (SELECT user_id, median(gap) AS median FROM g GROUP BY 1),
c AS (SELECT g.*, sum(CASE WHEN gap > 1.5 * median THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g JOIN m USING (user_id))
SELECT user_id, cast(segment AS BIGINT) AS segment, count(*) AS n, max(t) - min(t) AS span FROM c GROUP BY 1, 2
""")
def gap_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a user's events, cut where the gap exceeds one and a half medians."""
    g = windows.gap_segments(events(spark, d), key=["user_id"], time="t", tie="event_id")
    return g.groupBy("user_id", "segment").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))


@register(_E + """,
v AS (SELECT *, CASE WHEN event_type = 'click' THEN value END AS c FROM e)
SELECT event_id, round(coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), first_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS filled FROM v
""")
def ffill_bfill(spark: SparkSession, d: str) -> DataFrame:
    """Sparse click values filled forward, the head backward."""
    v = events(spark, d).withColumn("c", F.when(F.col("event_type") == "click", F.col("value")))
    return windows.fill(v, key=["user_id"], order=["t", "event_id"], value="c").select("event_id", r6("filled").alias("filled"))


@register("""
WITH r AS (SELECT o_orderstatus, o_orderkey, round(o_totalprice / 300000, 9) AS rate FROM orders), s AS (SELECT *, cast(round(rate * 1000000000) AS BIGINT) AS n, sum(cast(round(rate * 1000000000) AS BIGINT)) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS total FROM r)
SELECT o_orderkey, cast(total // 1000000000 - (total - n) // 1000000000 AS BIGINT) AS changes FROM s
""")
def change_counter(spark: SparkSession, d: str) -> DataFrame:
    """How often a running rate passes a whole number, in exact billionths."""
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", F.rint(F.round(F.col("o_totalprice") / 300000, 9) * 1_000_000_000).cast("long").alias("n"))
    return folds.change_counter(o, key=["o_orderstatus"], order="o_orderkey", rate="n", one=1_000_000_000).select("o_orderkey", "changes")


LIMITER_SQL = _E.replace("WITH e", "WITH RECURSIVE e") + """,
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id, value) AS k FROM e),
f AS (SELECT user_id, k, t + 43200000000 AS due, cast(NULL AS DOUBLE) AS wait, t AS s1, value AS v1, cast(NULL AS BIGINT) AS s0, cast(NULL AS DOUBLE) AS v0 FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.k,
 CASE WHEN o.t >= d THEN o.t + 43200000000 ELSE d END, CASE WHEN o.t >= d THEN NULL ELSE o.value END, CASE WHEN o.t >= d THEN o.t END, CASE WHEN o.t >= d THEN o.value END, CASE WHEN out THEN f.due END, CASE WHEN out THEN f.wait END
 FROM (SELECT *, due AS dd FROM f) f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1, LATERAL (SELECT f.wait IS NOT NULL AND o.t >= f.due AS out) x, LATERAL (SELECT CASE WHEN x.out THEN f.due + 43200000000 ELSE f.due END AS d) y),
z AS (SELECT user_id, max(k) AS k FROM o GROUP BY 1)
SELECT user_id, s1 AS at, v1 AS value FROM f WHERE s1 IS NOT NULL UNION ALL SELECT user_id, s0, v0 FROM f WHERE s0 IS NOT NULL UNION ALL SELECT f.user_id, f.due, f.wait FROM f JOIN z USING (user_id, k) WHERE f.wait IS NOT NULL
"""


@register(LIMITER_SQL)
def limiter(spark: SparkSession, d: str) -> DataFrame:
    """At most one event of a user in twelve hours, the latest waiting one deferred."""
    return folds.limiter(events(spark, d), key=["user_id"], time="t", tie="event_id", value="value", gap=12 * HOUR)


@register(_E + """,
s AS (SELECT user_id, t // 3600000000 AS step, arg_max(event_type, (t, event_id)) AS event_type FROM e GROUP BY 1, 2), p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY step) AS b FROM s)
SELECT user_id, step, event_type FROM p WHERE b IS NULL OR b <> event_type
""")
def last_per_slot_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Last state of a user in each hour, unchanged hours dropped."""
    return folds.last_per_slot(events(spark, d), slot=["user_id"], time="t", tie="event_id", width=HOUR, value="event_type")


@register(_E + """,
c AS (SELECT event_type, t, count(*) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM e)
SELECT event_type, max(n) AS peak, count(*) FILTER (n > 3) AS unsafe FROM c GROUP BY 1
""")
def sliding_risk(spark: SparkSession, d: str) -> DataFrame:
    """Peak number of events in any hour and the rows over three."""
    c = folds.sliding_count(events(spark, d), key=["event_type"], time="t", span=HOUR)
    return c.groupBy("event_type").agg(F.max("in_span").alias("peak"), F.count_if(F.col("in_span") > 3).alias("unsafe"))


@register(_E + """,
f AS (SELECT user_id, t, event_id, value < 5 AS flat FROM e), w AS (SELECT user_id, bool_and(flat) OVER x AS dead, count(*) OVER x AS n FROM f WINDOW x AS (PARTITION BY user_id ORDER BY t, event_id ROWS 1 PRECEDING))
SELECT user_id, coalesce(bool_or(dead AND n = 2), false) AS dead_output FROM w GROUP BY 1
""")
def dead_window(spark: SparkSession, d: str) -> DataFrame:
    """Does any window of two consecutive events lie wholly under the floor?"""
    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(-1, 0)
    flat = events(spark, d).select("user_id", F.every(F.col("value") < 5).over(w).alias("dead"), F.count("*").over(w).alias("n"))
    return flat.groupBy("user_id").agg(F.bool_or(F.col("dead") & (F.col("n") == 2)).alias("dead_output"))


@register(_E + """,
s AS (SELECT user_id, sign(value - lag(value) OVER w) AS s, abs(value - lag(value) OVER w) AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, count(*) FILTER (s > 0 AND a >= 10) AS up, count(*) FILTER (s < 0 AND a >= 10) AS down FROM s GROUP BY 1
""")
def flash_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Rises and falls of at least ten units between consecutive events."""
    step = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    return events(spark, d).select("user_id", step.alias("s")).groupBy("user_id").agg(F.count_if(F.col("s") >= 10).alias("up"), F.count_if(F.col("s") <= -10).alias("down"))


@register("""
WITH RECURSIVE c AS (SELECT l_linenumber AS g, l_returnflag AS s, avg(l_discount) * 100 AS c FROM lineitem GROUP BY 1, 2),
p AS (SELECT 1 AS g, s, c AS total, s AS path FROM c WHERE g = 1
UNION ALL SELECT p.g + 1, c.s, p.total + c.c + CASE WHEN c.s = p.s THEN 0 ELSE 0.05 END, p.path || '>' || c.s FROM p JOIN c ON c.g = p.g + 1)
SELECT round(total, 6) AS total, path FROM p WHERE g = 7 ORDER BY total, path LIMIT 1
""")
def viterbi(spark: SparkSession, d: str) -> DataFrame:
    """Cheapest path of return flags over the seven line numbers, a change costing 0.05."""
    c = table(spark, d, "lineitem").groupBy("l_linenumber", "l_returnflag").agg((F.avg("l_discount") * 100).alias("c"))
    return folds.cheapest_route(c, stage="l_linenumber", state="l_returnflag", cost="c", stages=list(range(1, 8)), move=0.05).select(r6("total").alias("total"), "path")


@register(_E + """,
x AS (SELECT user_id, event_type AS s, lag(event_type, 2) OVER w || '>' || lag(event_type, 1) OVER w AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
p AS (SELECT user_id, c, s, count(*) AS n FROM x WHERE c IS NOT NULL GROUP BY 1, 2, 3), z AS (SELECT user_id, c, sum(n) AS t FROM p GROUP BY 1, 2)
SELECT user_id, cast(sum(n) AS BIGINT) AS n, round(sum(-n * log2(n / t)), 4) AS bits, round(sum(-n * log2(n / t)) / sum(n), 6) AS rate FROM p JOIN z USING (user_id, c) GROUP BY 1
""")
def markov_surprisal(spark: SparkSession, d: str) -> DataFrame:
    """Order-2 surprisal of each user's event types."""
    m = series.markov_surprisal(events(spark, d), key=["user_id"], order_by=["t", "event_id"], symbol="event_type")
    return m.select("user_id", "n", F.round("bits", 4).alias("bits"), r6("rate").alias("rate"))


@register("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, cast(sum(n) AS BIGINT) AS n, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY 1")
def entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of each user's event types."""
    return series.entropy(events(spark, d), key=["user_id"], symbol="event_type").select("user_id", "n", r6("entropy").alias("entropy"))


@register(_E + """,
v AS (SELECT user_id, t, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d FROM e), l AS (SELECT user_id, d, lag(d, 1) OVER w AS a, lag(d, 2) OVER w AS b, lag(d, 3) OVER w AS c FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT user_id, count(*) AS n, sum(d * d) AS q, sum(d * a) AS a, sum(d * b) AS b, sum(d * c) AS c FROM l GROUP BY 1)
SELECT user_id, n, cast(lag AS INT) AS lag, round(coalesce(CASE lag WHEN 1 THEN a WHEN 2 THEN b ELSE c END, 0) / q, 6) AS acf FROM s, (SELECT unnest([1, 2, 3]) AS lag)
""")
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    """Autocorrelation of each user's values at three lags."""
    a = series.autocorrelation(events(spark, d), key=["user_id"], order_by=["t", "event_id"], value="value", lags=[1, 2, 3])
    return a.select("user_id", "n", "lag", r6("acf").alias("acf"))


@register(_E + """,
v AS (SELECT user_id, t, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d FROM e), l AS (SELECT user_id, d, lag(d, 1) OVER (PARTITION BY user_id ORDER BY t, event_id) AS a FROM v),
s AS (SELECT user_id, count(*) AS n, coalesce(sum(d * a), 0) / sum(d * d) AS r FROM l GROUP BY 1)
SELECT user_id, n, round(r, 6) AS lag1, round(least(greatest(n * (1 - r) / (1 + r), 1.0), n), 5) AS effective FROM s
""")
def effective_n(spark: SparkSession, d: str) -> DataFrame:
    """Effective sample size of each user's values."""
    e = series.effective_n(events(spark, d), key=["user_id"], order_by=["t", "event_id"], value="value")
    return e.select("user_id", "n", r6("lag1").alias("lag1"), F.round("effective", 5).alias("effective"))


@register("""
WITH a AS (SELECT event_type, (epoch_us(ts) % 86400000000) / 86400000000.0 * 2 * pi() AS a FROM events)
SELECT event_type, count(*) AS n, round(sqrt(avg(cos(a)) ** 2 + avg(sin(a)) ** 2), 6) AS resultant, round(atan2(avg(sin(a)), avg(cos(a))), 5) AS direction FROM a GROUP BY 1
""")
def circular_resultant(spark: SparkSession, d: str) -> DataFrame:
    """Time of day as an angle: resultant length and direction of each event type."""
    a = events(spark, d).withColumn("angle", (F.col("t") % (24 * HOUR)) / F.lit(float(24 * HOUR)) * 2 * F.pi())
    c = series.circular(a, key=["event_type"], angle="angle")
    return c.select("event_type", "n", r6("resultant").alias("resultant"), F.round("direction", 5).alias("direction"))


@register("""
WITH a AS (SELECT event_type, (epoch_us(ts) // 3600000000) % 24 AS phase, value FROM events), m AS (SELECT *, avg(value) OVER (PARTITION BY event_type, phase) AS c, avg(value) OVER (PARTITION BY event_type) AS g FROM a)
SELECT event_type, count(*) AS n, round(sum((value - c) ** 2) / sum((value - g) ** 2), 6) AS left_share FROM m GROUP BY 1
""")
def phase_fold(spark: SparkSession, d: str) -> DataFrame:
    """Variance left after the mean of each hour of day."""
    a = events(spark, d).withColumn("phase", F.floor(F.col("t") / HOUR) % 24)
    return series.phase_fold(a, key=["event_type"], phase="phase", value="value").select("event_type", "n", r6("left").alias("left_share"))


@register(_E + """,
b AS (SELECT user_id, t, event_id, t // 86400000000 AS day FROM e), s AS (SELECT user_id, day, count(*) AS n FROM b GROUP BY 1, 2)
SELECT user_id, day, n, cast(sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS before FROM s
""")
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Exclusive running counts: where each day of a user begins."""
    s = events(spark, d).groupBy("user_id", F.floor(F.col("t") / (24 * HOUR)).alias("day")).agg(F.count("*").alias("n"))
    return s.withColumn("before", F.sum("n").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
