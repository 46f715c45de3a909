"""Clip and control queries: safe ranges, messages, circular steps, leads, runs of agreement, dwells and cliffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.operators import windows
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6, table

HOUR = 3_600_000_000
DAY = 24 * HOUR
_E = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events)"


def _by_user() -> WindowSpec:
    return Window.partitionBy("user_id")


def _in_time() -> WindowSpec:
    return _by_user().orderBy("t", "event_id")


def _place() -> Column:
    """Number of an event of its user, from zero."""
    return F.row_number().over(_in_time()).cast("long") - 1


@register("""
WITH d AS (SELECT p_partkey, (p_partkey * 37) % 1024 AS a, least(1023, (p_partkey * 37) % 1024 + p_size * 10) AS b, 2 + p_size % 7 AS n FROM part),
r AS (SELECT p_partkey, n, CASE WHEN a >= 1023 - b THEN 0 ELSE b + 1 END AS low, CASE WHEN a >= 1023 - b THEN a - 1 ELSE 1023 END AS high FROM d WHERE a > 0 OR b < 1023),
v AS (SELECT *, unnest(range(n)) AS i FROM r)
SELECT p_partkey, i, cast(low AS BIGINT) AS low, cast(high AS BIGINT) AS high, cast(greatest(1, round_even(1023 / (2.0 * (n - 1)), 0)) AS BIGINT) AS margin, cast(low + round_even((high - low) * i / cast(n - 1 AS DOUBLE), 0) AS BIGINT) AS value FROM v
""")
def safe_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Widest interval of each part clear of its dead zone (the lower on a tie), evenly spread values in it and half their step."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 1024).alias("a"), (F.col("p_size") * 10).alias("width"), (2 + F.col("p_size") % 7).alias("n"))
    p = p.withColumn("b", F.least(F.lit(1023), F.col("a") + F.col("width"))).where("a > 0 OR b < 1023")
    below = F.col("a") >= 1023 - F.col("b")
    r = p.withColumns({"low": F.when(below, 0).otherwise(F.col("b") + 1), "high": F.when(below, F.col("a") - 1).otherwise(1023)})
    v = r.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    margin = F.greatest(F.lit(1.0), F.rint(1023 / (2.0 * (F.col("n") - 1))))
    value = F.col("low") + F.rint((F.col("high") - F.col("low")) * F.col("i") / (F.col("n") - 1).cast("double"))
    return v.select("p_partkey", F.col("i").cast("long").alias("i"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), margin.cast("long").alias("margin"), value.cast("long").alias("value"))


@register(_E + """,
s AS (SELECT event_id, event_id % 64 AS cc, least(16383, greatest(0, cast(floor(value * 100) AS BIGINT))) AS code FROM e)
SELECT event_id, 0 AS part, cc, code // 128 AS byte FROM s UNION ALL SELECT event_id, 1, cc + 32, code % 128 FROM s WHERE cc < 32
""")
def expected_messages(spark: SparkSession, d: str) -> DataFrame:
    """Controller messages that each send takes: a high byte, and for controllers below 32 a low byte 32 controllers up."""
    code = F.least(F.lit(16383), F.greatest(F.lit(0), F.floor(F.col("value") * 100)))
    s = events(spark, d).select("event_id", (F.col("event_id") % 64).alias("cc"), code.alias("code"))
    high = F.struct(F.lit(0).alias("part"), F.col("cc").alias("cc"), F.shiftright("code", 7).alias("byte"))
    low = F.struct(F.lit(1).alias("part"), (F.col("cc") + 32).alias("cc"), F.col("code").bitwiseAND(127).alias("byte"))
    return s.select("event_id", F.explode(F.when(F.col("cc") < 32, F.array(high, low)).otherwise(F.array(high))).alias("m")).select("event_id", "m.*")


_LEADS = _E + """,
s AS (SELECT user_id, value, (t - lag(t) OVER w) / 1e6 AS gap, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2, lag(value, 3) OVER w AS v3 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
l AS (SELECT user_id, gap, unnest(range(4)) AS lead, unnest([value, v1, v2, v3]) AS v FROM s WHERE gap IS NOT NULL AND v3 IS NOT NULL),
c AS (SELECT user_id, lead, count(*) AS n, avg(v) AS source, avg(gap) AS output, corr(v, gap) AS r FROM l GROUP BY 1, 2 HAVING count(*) > 4 AND stddev_pop(v) > 0 AND stddev_pop(gap) > 0),
z AS (SELECT *, round(abs(atanh(least(0.999999, greatest(-0.999999, r)))) * sqrt(n - 3), 6) AS z FROM c)
"""


def _leads(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of a user's gaps with the values 0 to 3 events before, as r and z."""
    earlier = [F.lag("value", k).over(_in_time()) if k else F.col("value") for k in range(4)]
    s = events(spark, d).select("user_id", ((F.col("t") - F.lag("t").over(_in_time())) / 1e6).alias("gap"), F.array(*earlier).alias("v"))
    l = s.where(F.col("gap").isNotNull() & F.get("v", F.lit(3)).isNotNull()).select("user_id", "gap", F.posexplode("v").alias("lead", "v"))
    c = l.groupBy("user_id", "lead").agg(F.count("*").alias("n"), F.avg("v").alias("source"), F.avg("gap").alias("output"), F.corr("v", "gap").alias("r"), F.stddev_pop("v").alias("sv"), F.stddev_pop("gap").alias("sg")).where("n > 4 AND sv > 0 AND sg > 0")
    return c.withColumn("z", F.round(F.abs(F.atanh(F.least(F.lit(0.999999), F.greatest(F.lit(-0.999999), F.col("r"))))) * F.sqrt(F.col("n") - 3), 6))


@register(_LEADS + """
SELECT user_id, arg_max(lead, (z, -lead)) AS lead, max(n) AS n, max(z) AS z, round(arg_max(r, (z, -lead)), 6) AS r, round(arg_max(source, (z, -lead)), 6) AS source, round(arg_max(output, (z, -lead)), 6) AS output FROM z GROUP BY 1
""")
def lead_survival(spark: SparkSession, d: str) -> DataFrame:
    """How a user's gaps follow the values before them: the lead of largest z (the least on a tie), its correlation and means."""
    best = _leads(spark, d).groupBy("user_id").agg(F.max_by(F.struct("lead", "n", "z", "r", "source", "output"), F.struct("z", (-F.col("lead")).alias("l"))).alias("b"))
    return best.select("user_id", F.col("b.lead").cast("long").alias("lead"), "b.n", "b.z", r6("b.r").alias("r"), r6("b.source").alias("source"), r6("b.output").alias("output"))


@register(_LEADS + """
SELECT user_id, count(*) AS leads, count(*) FILTER (z >= 1) AS followed, count(DISTINCT z >= 1) > 1 AS ambiguous, CASE WHEN count(DISTINCT z >= 1) = 1 THEN bool_and(z >= 1) END AS verdict FROM z GROUP BY 1
""")
def lead_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a user's gaps follow its values at each candidate lead; ambiguous, without a verdict, where the leads disagree."""
    follows = F.col("z") >= 1
    v = _leads(spark, d).groupBy("user_id").agg(F.count("*").alias("leads"), F.count_if(follows).alias("followed"))
    ambiguous = (F.col("followed") > 0) & (F.col("followed") < F.col("leads"))
    return v.select("user_id", "leads", "followed", ambiguous.alias("ambiguous"), F.when(~ambiguous, F.col("followed") > 0).alias("verdict"))


@register(_E + """,
s AS (SELECT event_id, abs(value - lag(value, 1) OVER w) AS d1, abs(value - lag(value, 2) OVER w) AS d2, abs(value - lag(value, 3) OVER w) AS d3, abs(value - lag(value, 4) OVER w) AS d4 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, CASE WHEN coalesce(d1, 0) < 10 THEN 0 WHEN coalesce(d2, 0) < 10 THEN 1 WHEN coalesce(d3, 0) < 10 THEN 2 WHEN coalesce(d4, 0) < 10 THEN 3 ELSE 4 END AS moving FROM s
""")
def moving_lags(spark: SparkSession, d: str) -> DataFrame:
    """Last lag, tested in order, at which an event's value still departs from those before it."""
    out = F.lit(4)
    for k in range(4, 0, -1):
        out = F.when(F.coalesce(F.abs(F.col("value") - F.lag("value", k).over(_in_time())), F.lit(0.0)) < 10, k - 1).otherwise(out)
    return events(spark, d).select("event_id", out.alias("moving"))


@register(_E + """,
s AS (SELECT user_id, cast(floor(value) AS BIGINT) % 16 AS code, row_number() OVER w - 1 AS i, lag(cast(floor(value) AS BIGINT) % 16) OVER w AS b FROM e WHERE value >= 0 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
k AS (SELECT user_id, count(*) AS n, avg(CASE WHEN (code - b + 16) % 16 = 0 THEN 1.0 ELSE 0.0 END) FILTER (b IS NOT NULL) AS repeats, avg(CASE WHEN (code - b + 16) % 16 > 1 THEN 1.0 ELSE 0.0 END) FILTER (b IS NOT NULL) AS scrambles FROM s GROUP BY 1),
o AS (SELECT user_id, (code - i % 16 + 16) % 16 AS shift, count(*) AS c FROM s GROUP BY 1, 2),
m AS (SELECT user_id, arg_max(shift, (c, -shift)) AS shift, max(c) AS c FROM o GROUP BY 1)
SELECT user_id, n, round(repeats, 6) AS repeats, round(scrambles, 6) AS scrambles, shift, round(c / n, 6) AS agreement FROM k JOIN m USING (user_id)
""")
def circular_steps(spark: SparkSession, d: str) -> DataFrame:
    """Shares of repeated and scrambled steps of a user's codes round a circle of 16, and the share at the most common shift."""
    e = events(spark, d).where("value >= 0").withColumn("code", F.floor("value") % 16)
    s = e.select("user_id", "code", _place().alias("i"), F.pmod(F.col("code") - F.lag("code").over(_in_time()), F.lit(16)).alias("step"))
    o = s.groupBy("user_id", F.pmod(F.col("code") - F.col("i"), F.lit(16)).alias("shift")).agg(F.count("*").alias("c"), F.count("step").alias("steps"), F.count_if(F.col("step") == 0).alias("same"), F.count_if(F.col("step") > 1).alias("wild"))
    m = o.groupBy("user_id").agg(F.sum("c").alias("n"), F.sum("steps").alias("steps"), F.sum("same").alias("same"), F.sum("wild").alias("wild"), F.max_by("shift", F.struct("c", (-F.col("shift")).alias("s"))).alias("shift"), F.max("c").alias("c"))
    share = lambda c: r6(F.try_divide(F.col(c), F.col("steps")))
    return m.select("user_id", "n", share("same").alias("repeats"), share("wild").alias("scrambles"), "shift", r6(F.col("c") / F.col("n")).alias("agreement"))


@register(_E + """,
s AS (SELECT user_id, event_id, value - avg(value) OVER u AS centred, stddev_pop(value) OVER u AS sd, min(value) OVER u AS low, max(value) OVER u AS high, value FROM e WINDOW u AS (PARTITION BY user_id))
SELECT event_id, round(CASE WHEN sd > 1e-9 THEN centred / sd ELSE centred END, 6) AS standard, CASE WHEN high > low THEN least(7, cast(floor((value - low) / (high - low) * 8) AS BIGINT)) ELSE 0 END AS bin FROM s
""")
def standardised_series(spark: SparkSession, d: str) -> DataFrame:
    """A user's values at zero mean and unit deviation (only centred where flat), and their left-closed bin of eight over the range."""
    e = events(spark, d)
    # a row a user, joined back, so that no user's events have to be in one task
    u = e.groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    s = e.join(u, "user_id").withColumn("centred", F.col("value") - F.col("mean"))
    bin = F.when(F.col("high") > F.col("low"), F.least(F.lit(7), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * 8))).otherwise(0)
    return s.select("event_id", r6(F.when(F.col("sd") > 1e-9, F.col("centred") / F.col("sd")).otherwise(F.col("centred"))).alias("standard"), bin.alias("bin"))


@register(_E + """,
s AS (SELECT user_id, event_id, row_number() OVER w - 1 AS i, lag(value) OVER w AS a, value AS b, lead(value) OVER w AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
p AS (SELECT user_id, arg_max({'i': i, 'a': a, 'b': b, 'c': c}, (b, -i)) AS p FROM s GROUP BY 1)
SELECT user_id, p.i AS place, round(p.b, 6) AS top, round(p.i + CASE WHEN p.a IS NULL OR p.c IS NULL OR p.a - 2 * p.b + p.c = 0 THEN 0 ELSE 0.5 * (p.a - p.c) / (p.a - 2 * p.b + p.c) END, 6) AS refined FROM p
""")
def refined_peaks(spark: SparkSession, d: str) -> DataFrame:
    """A user's largest value (the first on a tie) and its place on the parabola through its neighbours; an end stays as it is."""
    s = events(spark, d).select("user_id", _place().alias("i"), F.lag("value").over(_in_time()).alias("a"), F.col("value").alias("b"), F.lead("value").over(_in_time()).alias("c"))
    p = s.groupBy("user_id").agg(F.max_by(F.struct("i", "a", "b", "c"), F.struct("b", (-F.col("i")).alias("j"))).alias("p")).select("user_id", "p.*")
    bend = F.col("a") - 2 * F.col("b") + F.col("c")
    return p.select("user_id", F.col("i").alias("place"), r6("b").alias("top"), r6(F.col("i") + F.coalesce(F.try_divide(0.5 * (F.col("a") - F.col("c")), bend), F.lit(0.0))).alias("refined"))


@register("""
WITH c AS (SELECT c_custkey, (2.5 + (c_custkey % 7) * 0.75) / 0.5 AS f FROM customer), h AS (SELECT c_custkey, cast(round_even(f * unnest(range(1, 26)), 0) AS BIGINT) AS centre FROM c), b AS (SELECT c_custkey, centre + unnest(range(-1, 2)) AS bin FROM h)
SELECT DISTINCT c_custkey, bin FROM b WHERE bin < 64
""")
def harmonic_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins of 64 within one of a harmonic of each customer's fundamental."""
    f = (F.lit(2.5) + (F.col("c_custkey") % 7) * 0.75) / 0.5
    near = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda k: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda o: F.rint(f * k).cast("long") + o)))
    bins = F.array_distinct(F.filter(near, lambda b: b < 64))
    return table(spark, d, "customer").select("c_custkey", F.explode(bins).alias("bin"))


@register("""
SELECT l_suppkey, l_returnflag, l_linestatus, count(DISTINCT l_quantity) AS settings, cast(list_sort(list(DISTINCT l_quantity))[count(DISTINCT l_quantity) // 2 + 1] AS DOUBLE) AS representative FROM lineitem GROUP BY 1, 2, 3
""")
def gating_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of settings that are gated alike, and the middle setting of each (the upper of two)."""
    distinct = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity").distinct()
    held = distinct.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.array_sort(F.collect_list("l_quantity")).alias("q"))
    return held.select("l_suppkey", "l_returnflag", "l_linestatus", F.size("q").cast("long").alias("settings"), F.get("q", F.expr("cast(size(q) div 2 as int)")).cast("double").alias("representative"))


@register("""
WITH m AS (SELECT l_partkey, l_quantity AS level, avg(cast(l_extendedprice AS DOUBLE)) AS mean FROM lineitem GROUP BY 1, 2),
j AS (SELECT l_partkey, level, abs(mean - lag(mean) OVER (PARTITION BY l_partkey ORDER BY level)) AS jump, max(mean) OVER (PARTITION BY l_partkey) - min(mean) OVER (PARTITION BY l_partkey) AS reach FROM m)
SELECT l_partkey, cast(level AS DOUBLE) AS level, round(jump, 4) AS jump FROM j WHERE jump >= 0.3 * reach
""")
def cliff_atlas(spark: SparkSession, d: str) -> DataFrame:
    """Levels of each part where its mean response jumps by three tenths of its reach or more."""
    m = table(spark, d, "lineitem").groupBy("l_partkey", F.col("l_quantity").alias("level")).agg(F.avg(F.col("l_extendedprice").cast("double")).alias("mean"))
    by_part = Window.partitionBy("l_partkey")
    j = m.select("l_partkey", "level", F.abs(F.col("mean") - F.lag("mean").over(by_part.orderBy("level"))).alias("jump"), (F.max("mean").over(by_part) - F.min("mean").over(by_part)).alias("reach"))
    return j.where("jump >= 0.3D * reach").select("l_partkey", F.col("level").cast("double").alias("level"), F.round("jump", 4).alias("jump"))


@register(_E + """,
s AS (SELECT user_id, event_id, event_type, t, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) // 3600000000 AS lag FROM e),
c AS (SELECT user_id, lag, count(*) AS n FROM s WHERE lag IS NOT NULL GROUP BY 1, 2), m AS (SELECT user_id, arg_max(lag, (n, -lag)) AS mode FROM c GROUP BY 1),
a AS (SELECT s.*, mode, abs(lag - mode) <= 6 AS agrees FROM s JOIN m USING (user_id) WHERE lag IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, agrees ORDER BY t, event_id) AS island FROM a)
SELECT user_id, mode, min(t) AS since, count(*) AS n, count(DISTINCT event_type) AS kinds FROM i WHERE agrees GROUP BY user_id, mode, island HAVING count(*) >= 2 AND count(DISTINCT event_type) >= 2
""")
def agreeing_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more gaps near a user's most common one (in hours, the least on a tie) that are not all of one type."""
    s = events(spark, d).withColumn("lag", F.floor((F.col("t") - F.lag("t").over(_in_time())) / HOUR)).where("lag IS NOT NULL")
    m = s.groupBy("user_id", "lag").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max_by("lag", F.struct("n", (-F.col("lag")).alias("l"))).alias("mode"))
    a = s.join(m, "user_id").withColumn("agrees", F.abs(F.col("lag") - F.col("mode")) <= 6)
    runs = windows.islands(a, key=["user_id"], order=["t", "event_id"], same="agrees").where("agrees").groupBy("user_id", "mode", "island")
    return runs.agg(F.min("t").alias("since"), F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds")).where("n >= 2 AND kinds >= 2").drop("island")


@register(_E + """,
b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS device, (t - min(t) OVER (PARTITION BY user_id)) / 86400000000.0 AS host FROM e)
SELECT user_id, count(*) AS polls, round(avg(device - host), 6) AS mean, round(stddev_pop(device - host), 6) AS deviation, round(max(abs(device - host)), 6) AS worst, round(max(device) / max(host), 6) AS per_beat FROM b WHERE device > 0 AND host > 0 GROUP BY 1
""")
def beat_tracking(spark: SparkSession, d: str) -> DataFrame:
    """A device's beats (a user's events) against the host's (days) after the first one: mean, spread and worst difference, and their ratio."""
    b = events(spark, d).select("user_id", _place().alias("device"), ((F.col("t") - F.min("t").over(_by_user())) / float(DAY)).alias("host")).where("device > 0 AND host > 0")
    off = F.col("device") - F.col("host")
    return b.groupBy("user_id").agg(F.count("*").alias("polls"), r6(F.avg(off)).alias("mean"), r6(F.stddev_pop(off)).alias("deviation"), r6(F.max(F.abs(off))).alias("worst"), r6(F.max("device") / F.max("host")).alias("per_beat"))


@register(_E + """,
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS island FROM e),
r AS (SELECT user_id, event_type, island, min(t) AS since, arg_min(event_id, (t, event_id)) AS first_event, count(*) AS n FROM i GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY since, first_event) - 1 AS run, count(*) OVER (PARTITION BY user_id) AS runs FROM r)
SELECT user_id, run, first_event, n FROM k WHERE run IN (0, cast(round_even((runs - 1) / 2.0, 0) AS BIGINT), runs - 1)
""")
def spread_dwells(spark: SparkSession, d: str) -> DataFrame:
    """Three dwells of each user spread evenly over its runs of one type: the first, the middle and the last."""
    runs = windows.islands(events(spark, d), key=["user_id"], order=["t", "event_id"], same="event_type")
    r = runs.groupBy("user_id", "event_type", "island").agg(F.min(F.struct("t", "event_id")).alias("first"), F.count("*").alias("n"))
    k = r.select("user_id", (F.row_number().over(_by_user().orderBy("first")).cast("long") - 1).alias("run"), F.count("*").over(_by_user()).alias("runs"), F.col("first.event_id").alias("first_event"), "n")
    return k.where((F.col("run") == 0) | (F.col("run") == F.col("runs") - 1) | (F.col("run") == F.rint((F.col("runs") - 1) / 2.0).cast("long"))).drop("runs")


@register(_E + """,
s AS (SELECT user_id, event_type, t, value - lag(value) OVER w AS step FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, event_id)),
g AS (SELECT user_id, event_type, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t) AS gap FROM s WHERE abs(step) >= 1)
SELECT user_id, event_type, min(gap) AS least_gap, coalesce(min(gap) < 86400000000, false) AS reachable FROM g GROUP BY 1, 2
""")
def reachable_settings(spark: SparkSession, d: str) -> DataFrame:
    """Least gap of two changes of a setting, and whether any is shorter than a day's settling."""
    w = Window.partitionBy("user_id", "event_type")
    s = events(spark, d).withColumn("step", F.col("value") - F.lag("value").over(w.orderBy("t", "event_id"))).where(F.abs("step") >= 1)
    g = s.withColumn("gap", F.col("t") - F.lag("t").over(w.orderBy("t"))).groupBy("user_id", "event_type").agg(F.min("gap").alias("least_gap"))
    return g.withColumn("reachable", F.coalesce(F.col("least_gap") < DAY, F.lit(False)))


@register(_E + """,
f AS (SELECT user_id, t // 86400000000 AS day FROM e GROUP BY 1, 2 HAVING count(*) >= 2), i AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM f),
s AS (SELECT user_id, min(day) AS a, max(day) + 1 AS b FROM i GROUP BY user_id, island)
SELECT user_id, string_agg(a || '-' || b, ', ' ORDER BY a) AS spans, count(*) AS n FROM s GROUP BY 1
""")
def unsafe_spans(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of days with two or more events of a user, as text."""
    f = events(spark, d).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("n")).where("n >= 2")
    i = f.select("user_id", "day", (F.col("day") - F.row_number().over(_by_user().orderBy("day"))).alias("island"))
    s = i.groupBy("user_id", "island").agg(F.min("day").alias("a"), (F.max("day") + 1).alias("b"))
    spans = F.array_sort(F.collect_list(F.struct("a", "b")))
    return s.groupBy("user_id").agg(F.array_join(F.transform(spans, lambda p: F.concat_ws("-", p["a"].cast("string"), p["b"].cast("string"))), ", ").alias("spans"), F.count("*").alias("n"))


@register(_E + """,
s AS (SELECT user_id, event_id, value, t, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) // 8 AS chunk FROM e)
SELECT user_id, chunk, count(*) AS n, min(t) AS since, max(t) - min(t) AS length, string_agg(cast(event_id AS VARCHAR), ',' ORDER BY t, event_id) AS placed FROM s GROUP BY 1, 2
""")
def placed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A user's events dealt in order to chunks of eight: their span and members."""
    s = events(spark, d).withColumn("chunk", F.floor(_place() / 8))
    members = F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id"))), lambda m: m["event_id"].cast("string"))
    return s.groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.min("t").alias("since"), (F.max("t") - F.min("t")).alias("length"), F.array_join(members, ",").alias("placed"))


@register("""
WITH s AS (SELECT p_partkey, unnest([0, 341, 341, 682, 1023]) AS selector, unnest(range(5)) AS k, p_size * 20 AS v FROM part),
m AS (SELECT p_partkey, 3 * k + i AS place, selector, CASE WHEN i <> 1 THEN v WHEN v >= 512 THEN 0 ELSE 1023 END AS mover FROM s CROSS JOIN range(3) AS r(i)),
c AS (SELECT *, lag(selector) OVER w = selector AND lag(mover) OVER w = mover AS again FROM m WINDOW w AS (PARTITION BY p_partkey ORDER BY place))
SELECT p_partkey, place, selector, cast(mover AS BIGINT) AS mover FROM c WHERE again IS DISTINCT FROM true
""")
def joint_states(spark: SparkSession, d: str) -> DataFrame:
    """Selector settings of each part, under each a move to the mover's farthest value and back; states that repeat the one before are dropped."""
    far = F.when(F.col("v") >= 512, 0).otherwise(1023)
    states = [F.struct(F.lit(3 * k + i).cast("long").alias("place"), F.lit(selector).alias("selector"), (far if i == 1 else F.col("v")).cast("long").alias("mover")) for k, selector in enumerate((0, 341, 341, 682, 1023)) for i in range(3)]
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20).alias("v")).withColumn("s", F.array(*states))
    new = F.filter("s", lambda x, i: (i == 0) | (F.get("s", i - 1)["selector"] != x["selector"]) | (F.get("s", i - 1)["mover"] != x["mover"]))
    return p.select("p_partkey", F.inline(new))


@register("""
SELECT p_partkey, p_partkey % 12 AS control, CASE WHEN p_partkey % 12 < 6 THEN 'pot' WHEN p_partkey % 12 < 11 THEN 'toggle' ELSE 'fader' END AS kind, CASE WHEN p_partkey % 12 < 6 THEN p_partkey % 12 WHEN p_partkey % 12 < 11 THEN 6 ELSE 7 END AS register,
CASE WHEN p_partkey % 12 BETWEEN 6 AND 10 THEN p_partkey % 12 - 6 ELSE 0 END AS bit, CASE WHEN p_partkey % 12 BETWEEN 6 AND 10 THEN 1 ELSE 10 END AS bits, cast(power(2, ceil(log2((p_size + 1) * (p_size + 2) / 2.0))) AS BIGINT) AS design FROM part
""")
def control_fields(spark: SparkSession, d: str) -> DataFrame:
    """Register and bits of each control (six pots, five toggles in one register, a fader), and the least power of two of settings for a quadratic model."""
    c = F.col("p_partkey") % 12
    toggle = (c >= 6) & (c < 11)
    kind = F.when(toggle, "toggle").when(c < 6, "pot").otherwise("fader")
    register_ = F.when(toggle, 6).when(c < 6, c).otherwise(7)
    design = F.pow(F.lit(2.0), F.ceil(F.log2((F.col("p_size") + 1) * (F.col("p_size") + 2) / 2.0)))
    return table(spark, d, "part").select("p_partkey", c.alias("control"), kind.alias("kind"), register_.cast("long").alias("register"), F.when(toggle, c - 6).otherwise(0).cast("long").alias("bit"), F.when(toggle, 1).otherwise(10).alias("bits"), design.cast("long").alias("design"))


@register(_E + """,
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS island FROM e),
r AS (SELECT user_id, event_type, min(t) AS a, max(t) AS z FROM i GROUP BY user_id, event_type, island),
n AS (SELECT user_id, event_type, a, lead(a) OVER (PARTITION BY user_id ORDER BY a, z) AS b FROM r)
SELECT user_id, event_type, count(*) AS shown, cast(sum(b - a) AS BIGINT) AS total, max(b - a) AS longest, cast(min(a) AS BIGINT) AS since FROM n GROUP BY 1, 2
""")
def displayed_spans(spark: SparkSession, d: str) -> DataFrame:
    """Stretches for which each type was the one on show, until the next took over: how many, their sum and the longest."""
    runs = windows.islands(events(spark, d), key=["user_id"], order=["t", "event_id"], same="event_type")
    r = runs.groupBy("user_id", "event_type", "island").agg(F.min("t").alias("a"))
    n = r.withColumn("length", F.lead("a").over(_by_user().orderBy("island")) - F.col("a"))
    return n.groupBy("user_id", "event_type").agg(F.count("*").alias("shown"), F.sum("length").alias("total"), F.max("length").alias("longest"), F.min("a").alias("since"))
