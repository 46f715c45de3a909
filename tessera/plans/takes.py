"""Judging queries: takes of events against plans, load, faults, effects and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.operators import joins, windows
from tessera.operators.robust import exact_median
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6, table
from tessera.session import kept

HOUR = 3_600_000_000
DAY = 24 * HOUR
_E = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events)"
#: messages that one write of a type takes
_WEIGHT = {"click": 1, "view": 1, "purchase": 2, "signup": 2, "error": 3}


def _weight() -> Column:
    c = F.lit(1)
    for kind, n in _WEIGHT.items():
        c = F.when(F.col("event_type") == kind, n).otherwise(c)
    return c


_WEIGHT_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in _WEIGHT.items()) + " ELSE 1 END"


@register(_E + f""",
f AS (SELECT user_id, t // 3600000000 AS frame, cast(sum({_WEIGHT_SQL}) AS BIGINT) AS load FROM e GROUP BY 1, 2)
SELECT user_id, cast(sum(load) AS BIGINT) AS messages, count(*) AS frames, max(load) AS most, arg_max(frame, (load, -frame)) AS busiest, median(load) AS middle FROM f GROUP BY 1
""")
def frame_load(spark: SparkSession, d: str) -> DataFrame:
    """Messages in each hour of a user: totals, the busiest hour (the first on a tie) and the median."""
    f = events(spark, d).groupBy("user_id", F.floor(F.col("t") / HOUR).alias("frame")).agg(F.sum(_weight()).alias("load"))
    return f.groupBy("user_id").agg(F.sum("load").alias("messages"), F.count("*").alias("frames"), F.max("load").alias("most"), F.max_by("frame", F.struct("load", (-F.col("frame")).alias("f"))).alias("busiest"), F.median("load").alias("middle"))


@register(_E + """
SELECT user_id, event_type, count(*) AS writes, round(min(value), 6) AS low, round(max(value), 6) AS high, round(arg_max(value, (t, event_id)), 6) AS final, cast(count(*) FILTER (value >= 50) AS BIGINT) AS strong FROM e GROUP BY 1, 2
""")
def layer_summary(spark: SparkSession, d: str) -> DataFrame:
    """Writes of each type of a user: how many, their range, the last and the strong ones."""
    return events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("writes"), r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"), r6(F.max_by("value", F.struct("t", "event_id"))).alias("final"), F.count_if(F.col("value") >= 50).alias("strong"))


@register(_E + """,
s AS (SELECT user_id, t // 86400000000 AS bar, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS step FROM e),
b AS (SELECT user_id, bar, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, count(*) FILTER (abs(step) >= 10) AS flashes, max(abs(step)) AS most FROM s GROUP BY 1, 2)
SELECT user_id, bar, n, CASE WHEN flashes > 3 THEN 'flashing' WHEN n > 1 AND sd < 3 THEN 'flat' WHEN coalesce(most, 0) < 5 THEN 'frozen' ELSE 'good' END AS fault, round(mean, 6) AS mean FROM b
""")
def bar_faults(spark: SparkSession, d: str) -> DataFrame:
    """Fault of each daily bar, the first of flashing, flat and frozen."""
    step = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    s = events(spark, d).withColumn("step", F.abs(step))
    b = s.groupBy("user_id", F.floor(F.col("t") / DAY).alias("bar")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count_if(F.col("step") >= 10).alias("flashes"), F.max("step").alias("most"))
    fault = F.when(F.col("flashes") > 3, "flashing").when((F.col("n") > 1) & (F.col("sd") < 3), "flat").when(F.coalesce("most", F.lit(0.0)) < 5, "frozen").otherwise("good")
    return b.select("user_id", "bar", "n", fault.alias("fault"), r6("mean").alias("mean"))


@register("""
WITH l AS (SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey), m AS (SELECT median(lag) AS m FROM l)
SELECT l_orderkey, count(*) AS steps, count(*) FILTER (abs(lag - m) <= 15) AS exact, count(*) FILTER (lag - m > 15) AS late, count(*) FILTER (lag - m < -15) AS early, CASE WHEN count(*) FILTER (abs(lag - m) > 15) = 0 THEN 'exact' WHEN count(*) FILTER (lag - m > 15) >= count(*) FILTER (lag - m < -15) THEN 'late' ELSE 'early' END AS verdict FROM l CROSS JOIN m GROUP BY 1
""")
def take_exactness(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order shipped within fifteen days of the median delay, later or earlier, and the verdict on the order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.datediff("l_shipdate", "o_orderdate").alias("lag"))
    lines = kept(lines.withColumn("_all", F.lit(0)))
    middle = exact_median(lines, key=["_all"], value="lag").select(F.col("median").alias("m"))  # one row
    off = F.col("lag") - F.col("m")
    c = lines.join(F.broadcast(middle)).groupBy("l_orderkey").agg(F.count("*").alias("steps"), F.count_if(F.abs(off) <= 15).alias("exact"), F.count_if(off > 15).alias("late"), F.count_if(off < -15).alias("early"))
    return c.withColumn("verdict", F.when(F.col("late") + F.col("early") == 0, "exact").when(F.col("late") >= F.col("early"), "late").otherwise("early"))


@register(_E + """,
g AS (SELECT user_id, t, row_number() OVER w AS seq, (t - lag(t) OVER w) / 1e6 AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
p AS (SELECT user_id, count(*) AS n, regr_slope(t / 1e6, seq) AS slope, median(gap) AS flip, (max(t) - min(t)) / 1e6 AS span FROM g GROUP BY 1)
SELECT user_id, n, round(slope, 2) AS period, round(flip, 4) AS flip, round((slope / flip - 1) * 1e6, 0) AS ppm, round(n * 64 / nullif(span, 0), 9) AS write_rate, round(span + span / (n - 1), 4) AS duration FROM p WHERE n > 2
""")
def capture_periods(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares period of a user's events, median interval, their mismatch, bytes a second and duration with a mean interval more."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    g = events(spark, d).select("user_id", "t", F.row_number().over(w).alias("seq"), ((F.col("t") - F.lag("t").over(w)) / 1e6).alias("gap"))
    p = g.groupBy("user_id").agg(F.count("*").alias("n"), F.regr_slope(F.col("t") / 1e6, F.col("seq")).alias("slope"), F.median("gap").alias("flip"), ((F.max("t") - F.min("t")) / 1e6).alias("span")).where("n > 2")
    return p.select("user_id", "n", F.round("slope", 2).alias("period"), F.round("flip", 4).alias("flip"), F.round((F.col("slope") / F.col("flip") - 1) * 1e6, 0).alias("ppm"), F.round(F.col("n") * 64 / F.nullif("span", F.lit(0.0)), 9).alias("write_rate"), F.round(F.col("span") + F.col("span") / (F.col("n") - 1), 4).alias("duration"))


@register("""
WITH o AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS states, sum(o_totalprice) AS total, count(*) FILTER (o_orderstatus = 'P') AS pending, min(o_orderdate) AS first FROM orders GROUP BY 1),
k AS (SELECT c_custkey, c_acctbal, coalesce(n, 0) AS n, coalesce(states, 0) AS states, total, coalesce(pending, 0) AS pending, first FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT finding, count(*) AS n, min(c_custkey) AS example FROM (
SELECT 'no orders' AS finding, c_custkey FROM k WHERE n = 0 UNION ALL SELECT 'one state only', c_custkey FROM k WHERE n > 1 AND states = 1 UNION ALL SELECT 'mostly pending', c_custkey FROM k WHERE 2 * pending > n
UNION ALL SELECT 'in debt', c_custkey FROM k WHERE c_acctbal < 0 AND n > 0 UNION ALL SELECT 'starts late', c_custkey FROM k WHERE first >= TIMESTAMP '1999-01-01' UNION ALL SELECT 'heavy', c_custkey FROM k WHERE total > 5000000) GROUP BY 1
""")
def diagnose(spark: SparkSession, d: str) -> DataFrame:
    """Named findings over customers and their orders; one pass tags each row with all that hold."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderstatus").alias("states"), F.sum("o_totalprice").alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.min("o_orderdate").alias("first"))
    k = table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    n = F.coalesce("n", F.lit(0))
    checks = {"no orders": n == 0, "one state only": (n > 1) & (F.col("states") == 1), "mostly pending": 2 * F.col("pending") > n, "in debt": (F.col("c_acctbal") < 0) & (n > 0), "starts late": F.col("first") >= F.lit("1999-01-01").cast("timestamp_ntz"), "heavy": F.col("total") > 5_000_000}
    tags = F.array_compact(F.array(*[F.when(check, F.lit(name)) for name, check in checks.items()]))
    return k.select("c_custkey", F.explode(tags).alias("finding")).groupBy("finding").agg(F.count("*").alias("n"), F.min("c_custkey").alias("example"))


@register(_E + """,
b AS (SELECT user_id, (t // 3600000000) % 48 AS mark FROM e), n AS (SELECT user_id, count(*) AS n FROM b GROUP BY 1), g AS (SELECT unnest([2, 3, 4, 6, 8, 12]) AS p),
h AS (SELECT b.user_id, p, count(*) FILTER (mark % p = 0) AS hits FROM b CROSS JOIN g GROUP BY 1, 2)
SELECT user_id, n, cast(coalesce(max(p) FILTER (2 * hits > n), 1) AS INT) AS phrase FROM h JOIN n USING (user_id) GROUP BY 1, 2
""")
def phrase_bars(spark: SparkSession, d: str) -> DataFrame:
    """Largest phrase length on whose grid more than half of a user's marks fall."""
    mark = F.floor(F.col("t") / HOUR) % 48
    hits = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), *[F.count_if(mark % p == 0).alias(f"h{p}") for p in (2, 3, 4, 6, 8, 12)])
    best = F.greatest(F.lit(1), *[F.when(2 * F.col(f"h{p}") > F.col("n"), p) for p in (2, 3, 4, 6, 8, 12)])
    return hits.select("user_id", "n", best.cast("int").alias("phrase"))


@register(_E + """,
v AS (SELECT event_type, user_id, t // 3600000000 AS h, avg(value) AS v FROM e GROUP BY 1, 2, 3), s AS (SELECT unnest([1, 2, 3, 6, 12]) AS shift),
p AS (SELECT a.event_type, shift, a.v AS a, b.v AS b FROM v a CROSS JOIN s JOIN v b ON b.event_type = a.event_type AND b.user_id = a.user_id AND b.h = a.h + shift),
z AS (SELECT event_type, shift, count(*) AS n, round(CASE WHEN count(*) > 3 AND abs(corr(a, b)) < 1 THEN atanh(corr(a, b)) * sqrt(count(*) - 3) ELSE 0 END, 6) AS z FROM p GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY z DESC, shift) AS k, lead(z) OVER (PARTITION BY event_type ORDER BY z DESC, shift) AS second FROM z)
SELECT event_type, cast(shift AS INT) AS shift, n, round(z, 4) AS z, round(z - second, 4) AS margin, coalesce(z - second > 1.96 * sqrt(2), false) AS clear FROM k WHERE k = 1
""")
def shift_selection(spark: SparkSession, d: str) -> DataFrame:
    """The shift of hours at which a type's values follow those before most closely, and whether by a clear margin."""
    v = events(spark, d).groupBy("event_type", "user_id", F.floor(F.col("t") / HOUR).alias("h")).agg(F.avg("value").alias("v"))
    shifted = v.select("event_type", "user_id", F.explode(F.array(*[F.lit(s) for s in (1, 2, 3, 6, 12)])).alias("shift"), (F.col("h") + F.col("shift")).alias("h"), F.col("v").alias("a"))
    p = shifted.join(v.withColumnRenamed("v", "b"), ["event_type", "user_id", "h"])
    z = p.groupBy("event_type", "shift").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r")).withColumn("z", r6(x.follow_z(F.col("r"), F.col("n"))))
    w = Window.partitionBy("event_type").orderBy(F.desc("z"), "shift")
    best = z.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("z").over(w)).where("k = 1")
    margin = F.col("z") - F.col("second")
    return best.select("event_type", "shift", "n", F.round("z", 4).alias("z"), F.round(margin, 4).alias("margin"), F.coalesce(margin > 1.96 * F.sqrt(F.lit(2.0)), F.lit(False)).alias("clear"))


@register(_E + """,
r AS (SELECT user_id, event_type, t // 86400000000 AS day, count(*) AS n, sum(value) AS v FROM e GROUP BY 1, 2, 3), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id, event_type ORDER BY day) AS island FROM r),
g AS (SELECT user_id, event_type, island, count(*) AS length, min(day) AS first, cast(sum(n) AS BIGINT) AS rows, sum(v) / sum(n) AS intensity, min(v / n) AS low, max(v / n) AS high FROM i GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY length DESC, first) AS k FROM g)
SELECT user_id, event_type, length, first, rows, round(intensity, 6) AS intensity, high - low < 5 AS static, intensity < 10 AS blank FROM k WHERE k = 1
""")
def setpoint_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effect of each type of a user on its longest run of consecutive days: intensity and flags."""
    r = events(spark, d).groupBy("user_id", "event_type", F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    island = F.col("day") - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("day"))
    mean = F.col("v") / F.col("n")
    g = r.withColumn("island", island).groupBy("user_id", "event_type", "island").agg(F.count("*").alias("length"), F.min("day").alias("first"), F.sum("n").alias("rows"), (F.sum("v") / F.sum("n")).alias("intensity"), F.min(mean).alias("low"), F.max(mean).alias("high"))
    best = g.groupBy("user_id", "event_type").agg(F.min(F.struct((-F.col("length")).alias("l"), "first", "length", "rows", "intensity", "low", "high")).alias("b")).select("user_id", "event_type", "b.*")
    return best.select("user_id", "event_type", "length", "first", "rows", r6("intensity").alias("intensity"), (F.col("high") - F.col("low") < 5).alias("static"), (F.col("intensity") < 10).alias("blank"))


@register("""
WITH o AS (SELECT o_orderpriority, o_orderstatus, o_totalprice AS v FROM orders)
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS blank, count(*) FILTER (o_orderstatus = 'P') AS flash, round(min(v), 4) AS low, round(max(v), 4) AS high, round(min(v) FILTER (o_orderstatus = 'O'), 4) AS safe_low, round(max(v) FILTER (o_orderstatus = 'O'), 4) AS safe_high FROM o GROUP BY 1
""")
def effect_summary(spark: SparkSession, d: str) -> DataFrame:
    """Flags and intensity ranges of each program, over all settings and over the safe ones."""
    v, safe = F.col("o_totalprice"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("blank"), F.count_if(F.col("o_orderstatus") == "P").alias("flash"), *[F.round(f(c), 4).alias(name) for name, f, c in (("low", F.min, v), ("high", F.max, v), ("safe_low", F.min, safe), ("safe_high", F.max, safe))])


@register("""
WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice, rank() OVER (ORDER BY o_totalprice) - 1 + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r, count(*) OVER () AS n FROM orders WHERE o_orderstatus <> 'P')
SELECT o_orderkey, o_orderpriority, round(r / (n - 1), 6) AS intensity FROM o
""")
def palettes(spark: SparkSession, d: str) -> DataFrame:
    """Safe settings of every program with their intensity as a mid-rank pooled over all programs."""
    safe = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderpriority", "o_totalprice")
    # ranges of values are ranked by themselves and moved up by the rows of the ranges before
    ranked = windows.pooled_midrank(safe, value="o_totalprice")
    return ranked.select("o_orderkey", "o_orderpriority", r6("midrank").alias("intensity"))


@register(_E + """,
l AS (SELECT event_type, unnest([1, 2, 3, 4]) AS lag, unnest([value - lag(value, 1) OVER w, value - lag(value, 2) OVER w, value - lag(value, 3) OVER w, value - lag(value, 4) OVER w]) AS d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
r AS (SELECT event_type, lag, d, rank() OVER (PARTITION BY event_type, lag ORDER BY abs(d)) + (count(*) OVER (PARTITION BY event_type, lag, abs(d)) - 1) / 2.0 AS r FROM l WHERE d <> 0),
z AS (SELECT event_type, lag, count(*) AS steps, abs(sum(sign(d) * r)) / sqrt(sum(r * r)) AS z FROM r GROUP BY 1, 2),
f AS (SELECT *, coalesce(min(CASE WHEN z <= 1.0 THEN lag END) OVER (PARTITION BY event_type), 5) AS stop FROM z)
SELECT event_type, cast(lag AS INT) AS lag, steps, round(z, 5) AS z, lag < stop AS moving, cast(stop - 1 AS INT) AS settle FROM f
""")
def response_lags(spark: SparkSession, d: str) -> DataFrame:
    """Signed-rank z of the change at each lag after an event, and the last lag of an unbroken sequence that departs."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    v = F.col("value")
    rows = events(spark, d).select("event_type", F.array(*[v - F.lag(v, k).over(w) for k in range(1, 5)]).alias("d")).select("event_type", F.posexplode("d").alias("lag", "d")).withColumn("lag", F.col("lag") + 1).where("d <> 0").withColumn("a", F.abs("d"))
    by = ["event_type", "lag"]
    counts = rows.groupBy(*by, "a").agg(F.count("*").alias("n"), F.sum(F.signum("d")).alias("s"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = counts.withColumn("r", below + (F.col("n") + 1) / F.lit(2.0).cast("double"))
    z = rank.groupBy(*by).agg(F.sum("n").alias("steps"), (F.abs(F.sum(F.col("s") * F.col("r"))) / F.sqrt(F.sum(F.col("n") * F.col("r") * F.col("r")))).alias("z"))
    stop = F.coalesce(F.min(F.when(F.col("z") <= 1.0, F.col("lag"))).over(Window.partitionBy("event_type")), F.lit(5))
    return z.withColumn("stop", stop).select("event_type", "lag", "steps", F.round("z", 5).alias("z"), (F.col("lag") < F.col("stop")).alias("moving"), (F.col("stop") - 1).cast("int").alias("settle"))


@register("""
WITH m AS (SELECT doc_id, n_chars >= 1000 AS measured FROM documents), j AS (SELECT lang, measured, quality = 1 AS labelled, doc_id FROM m JOIN documents USING (doc_id) JOIN labels USING (doc_id))
SELECT lang, count(*) AS n, round(avg(CASE WHEN measured = labelled THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (measured AND NOT labelled) AS measured_only, count(*) FILTER (labelled AND NOT measured) AS labelled_only, min(doc_id) FILTER (measured <> labelled) AS first_disagreement FROM j GROUP BY 1
""")
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of a measured decision with the labels where both commit, and where they disagree."""
    j = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") >= 1000).alias("m")).join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("l")), "doc_id")
    return j.groupBy("lang").agg(F.count("*").alias("n"), r6(F.avg((F.col("m") == F.col("l")).cast("double"))).alias("accuracy"), F.count_if(F.col("m") & ~F.col("l")).alias("measured_only"), F.count_if(F.col("l") & ~F.col("m")).alias("labelled_only"), F.min(F.when(F.col("m") != F.col("l"), F.col("doc_id"))).alias("first_disagreement"))


@register(_E + """,
p AS (SELECT user_id, t // 600000000 AS slot, event_type, arg_max(value, (t, event_id)) AS value FROM e GROUP BY 1, 2, 3),
q AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY slot) AS before FROM p)
SELECT user_id, event_type, slot, round(value, 6) AS value, cast(greatest(0, ceil(round((slot * 600 - 120) * 0.05, 6))) AS BIGINT) AS frame FROM q WHERE before IS NULL OR before <> value
""")
def write_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Last write of each slot of ten minutes, unchanged ones dropped, with the frame it aims at."""
    p = events(spark, d).groupBy("user_id", F.floor(F.col("t") / 600_000_000).alias("slot"), "event_type").agg(F.max_by("value", F.struct("t", "event_id")).alias("value"))
    before = F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy("slot"))
    frame = F.greatest(F.lit(0), F.ceil(F.round((F.col("slot") * 600 - 120) * 0.05, 6)))
    return p.withColumn("before", before).where("before is null or before <> value").select("user_id", "event_type", "slot", r6("value").alias("value"), frame.cast("long").alias("frame"))


@register(_E + """,
s AS (SELECT * FROM e WHERE event_type = 'click'), h AS (SELECT s.*, v.value AS held FROM s ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') v ON s.user_id = v.user_id AND s.t > v.t),
l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS last FROM h)
SELECT event_id, CASE WHEN held IS NULL THEN 'unsent' WHEN floor(value / 10) = floor(last / 10) THEN 'unchanged' WHEN held < 5 THEN 'dead' WHEN abs(value - held) < 1 THEN 'no-op' ELSE 'live' END AS verdict FROM l
""")
def classified_writes(spark: SparkSession, d: str) -> DataFrame:
    """Verdict on every click against the view that held: unsent, unchanged, dead, without effect or live."""
    held = joins.asof(events(spark, d, "click"), events(spark, d, "view"), key=["user_id"], time="t", values=["value"], tie="event_id")
    last = F.lag("value").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    v = F.when(F.col("r_value").isNull(), "unsent").when(F.floor(F.col("value") / 10) == F.floor(F.col("last") / 10), "unchanged").when(F.col("r_value") < 5, "dead").when(F.abs(F.col("value") - F.col("r_value")) < 1, "no-op").otherwise("live")
    return held.withColumn("last", last).select("event_id", v.alias("verdict"))


@register(_E + """,
g AS (SELECT event_id, user_id, t, event_type, t // 86400000000 AS frame FROM e), c AS (SELECT user_id, frame, count(*) AS n FROM g GROUP BY 1, 2), m AS (SELECT user_id, min(frame) AS a, max(frame) AS b FROM c GROUP BY 1)
SELECT c.user_id, count(*) AS frames, count(*) FILTER (n > 2) AS often, cast(max(b - a + 1) - 2 - count(*) AS BIGINT) AS absent FROM c JOIN m USING (user_id) WHERE frame > a AND frame < b GROUP BY 1
""")
def slips(spark: SparkSession, d: str) -> DataFrame:
    """Days of a user, end days aside, that were captured more than twice or not at all."""
    c = events(spark, d).groupBy("user_id", F.floor(F.col("t") / DAY).alias("frame")).agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    return c.join(m, "user_id").where("frame > a and frame < b").groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if(F.col("n") > 2).alias("often"), (F.max(F.expr("b - a + 1")) - 2 - F.count("*")).alias("absent"))


@register(_E + """,
b AS (SELECT user_id, max(t) FILTER (event_type = 'signup') AS good FROM e GROUP BY 1)
SELECT user_id, event_type, count(*) AS n FROM e JOIN b USING (user_id) WHERE good IS NULL OR t > good GROUP BY 1, 2
""")
def since_last_good(spark: SparkSession, d: str) -> DataFrame:
    """Events after the last healthy probe (signup) of each user, all where there was none."""
    e = events(spark, d)
    good = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("t"))).alias("good"))
    return e.join(good, "user_id").where("good is null or t > good").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
