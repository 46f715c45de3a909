"""Evidence, timing and summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.special import normal_quantile
from tessera.operators import windows
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6, table

HOUR = 3_600_000_000
_E = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events)"


@register(_E + """,
g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e), m AS (SELECT user_id, median(gap) AS median FROM g GROUP BY 1),
s AS (SELECT g.*, sum(CASE WHEN gap > 1.5 * median THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS seg, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g JOIN m USING (user_id)),
c AS (SELECT user_id, seg, count(*) AS n, sum(k) AS sk, sum(t / 1e6) AS st, sum(k * k) AS skk, sum(k * (t / 1e6)) AS skt FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS segments, round(sum(skt - sk * st / n) / sum(skk - sk * sk / cast(n AS DOUBLE)), 1) AS period FROM c GROUP BY 1 HAVING sum(skk - sk * sk / cast(n AS DOUBLE)) > 0
""")
def capture_line(spark: SparkSession, d: str) -> DataFrame:
    """Common slope of time over sequence with an intercept for each segment of a user."""
    seg = windows.gap_segments(events(spark, d), key=["user_id"], time="t", tie="event_id")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).cast("double")
    c = seg.withColumn("k", k).withColumn("s", F.col("t") / 1e6).groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.sum("k").alias("sk"), F.sum("s").alias("st"), F.sum(F.col("k") * F.col("k")).alias("skk"), F.sum(F.col("k") * F.col("s")).alias("skt"))
    spread = F.sum(F.expr("skk - sk * sk / n"))
    return c.groupBy("user_id").agg(F.count("*").alias("segments"), F.sum(F.expr("skt - sk * st / n")).alias("u"), spread.alias("v")).where("v > 0").select("user_id", "segments", F.round(F.col("u") / F.col("v"), 1).alias("period"))


@register(_E + """,
p AS (SELECT user_id, event_id, t, lag(t) OVER w AS before, lag(event_type) OVER w AS was, event_type FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, count(*) AS brackets, max(before) AS low, min(t) AS high, max(before) > min(t) AS crossed FROM p WHERE was = 'view' AND event_type = 'click' GROUP BY 1
""")
def tick_brackets(spark: SparkSession, d: str) -> DataFrame:
    """Brackets between consecutive polls that moved on, and the intersection of all brackets of a user."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = events(spark, d).select("user_id", "t", F.lag("t").over(w).alias("before"), F.lag("event_type").over(w).alias("was"), "event_type")
    b = p.where("was = 'view' and event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("brackets"), F.max("before").alias("low"), F.min("t").alias("high"))
    return b.withColumn("crossed", F.col("low") > F.col("high"))


@register("""
WITH p AS (SELECT l_shipmode, p FROM (SELECT l_returnflag AS l_shipmode, l_discount + 0.01 AS p FROM lineitem)), f AS (SELECT l_shipmode, count(*) AS n, -2 * sum(ln(p)) AS x FROM p GROUP BY 1)
SELECT l_shipmode AS pool, n, round(x, 4) AS statistic, round((pow(x / (2 * n), 1 / 3.0) - (1 - 2 / (9.0 * 2 * n))) / sqrt(2 / (9.0 * 2 * n)), 4) AS z FROM f
""")
def fisher_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Fisher's statistic of pooled p-values and its normal score by the cube-root approximation."""
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("pool"), (F.col("l_discount") + 0.01).alias("p"))
    f = p.groupBy("pool").agg(F.count("*").alias("n"), (-2 * F.sum(F.log("p"))).alias("x"))
    df, c = 2 * F.col("n").cast("double"), F.lit(1 / 3.0)
    return f.select("pool", "n", F.round("x", 4).alias("statistic"), F.round((F.pow(F.col("x") / df, c) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)), 4).alias("z"))


@register("""
WITH d AS (SELECT l_suppkey, l_extendedprice / l_quantity - 1500 AS d FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_suppkey, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0)
SELECT l_suppkey, count(*) AS n, round(sum(sign(d) * r) / sqrt(sum(r * r)), 6) AS z FROM r GROUP BY 1
""")
def signed_rank(spark: SparkSession, d: str) -> DataFrame:
    """Signed-rank score of each supplier's unit price against 1500."""
    x = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity") - 1500).alias("d")).where("d <> 0").withColumn("a", F.abs("d"))
    counts = x.groupBy("l_suppkey", "a").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("l_suppkey").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select("l_suppkey", "a", (below + (F.col("n") + 1) / F.lit(2.0).cast("double")).alias("r"))
    return x.join(ranks, ["l_suppkey", "a"]).groupBy("l_suppkey").agg(F.count("*").alias("n"), r6(F.sum(F.signum("d") * F.col("r")) / F.sqrt(F.sum(F.col("r") * F.col("r")))).alias("z"))


@register("""
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM orders GROUP BY 1), u AS (SELECT o_orderpriority, unnest(q) AS v, unnest(range(5)) AS i FROM q),
n AS (SELECT o.o_orderkey, u.i, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY abs(u.v - o.o_totalprice), u.i) AS k FROM orders o JOIN u USING (o_orderpriority))
SELECT o_orderkey, cast(i AS INT) AS setting FROM n WHERE k = 1
""")
def palette_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Nearest quantile of its priority for each order, the first on a tie."""
    o = table(spark, d, "orders")
    q = o.groupBy("o_orderpriority").agg(F.percentile("o_totalprice", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"))
    far = F.transform("q", lambda v, i: F.struct(F.abs(v - F.col("o_totalprice")).alias("d"), i.alias("i")))
    return o.join(F.broadcast(q), "o_orderpriority").select("o_orderkey", F.array_min(far)["i"].cast("int").alias("setting"))


@register("""
WITH s AS (SELECT median(value) FILTER (event_type = 'click') AS m1, median(value) FILTER (event_type = 'purchase') AS m2, quantile_cont(value, 0.25) FILTER (event_type = 'click') AS a, quantile_cont(value, 0.75) FILTER (event_type = 'purchase') AS b FROM events)
SELECT round(CASE WHEN a <= b THEN a ELSE (m1 + m2) / 2 END, 6) AS low, round(CASE WHEN a <= b THEN b ELSE (m1 + m2) / 2 END, 6) AS high FROM s
""")
def label_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Decision band from the quartiles of two labels, the middle of their medians where the quartiles cross."""
    of = lambda kind, q: F.percentile(F.when(F.col("event_type") == kind, F.col("value")), F.lit(q))
    s = events(spark, d).agg(of("click", 0.5).alias("m1"), of("purchase", 0.5).alias("m2"), of("click", 0.25).alias("a"), of("purchase", 0.75).alias("b"))
    middle, crossed = (F.col("m1") + F.col("m2")) / 2, F.col("a") > F.col("b")
    return s.select(r6(F.when(crossed, middle).otherwise(F.col("a"))).alias("low"), r6(F.when(crossed, middle).otherwise(F.col("b"))).alias("high"))


@register(_E + """,
b AS (SELECT user_id, t // 21600000000 AS beat, avg(value) AS v FROM e GROUP BY 1, 2), p AS (SELECT user_id, beat % 4 AS phase, avg(v) AS s, count(*) AS n FROM b GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, phase) AS k FROM p)
SELECT user_id, phase, n, round(s + 1e-9, 4) AS strength FROM k WHERE k = 1
""")
def downbeat_phase(spark: SparkSession, d: str) -> DataFrame:
    """The phase of four beats with the greatest mean strength."""
    b = events(spark, d).groupBy("user_id", F.floor(F.col("t") / (6 * HOUR)).alias("beat")).agg(F.avg("value").alias("v"))
    p = b.groupBy("user_id", (F.col("beat") % 4).alias("phase")).agg(F.avg("v").alias("s"), F.count("*").alias("n"))
    best = F.min_by(F.struct("phase", "n", "s"), F.struct(-F.round("s", 9), F.col("phase")))
    return p.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.phase", "b.n", F.round(F.col("b.s") + 1e-9, 4).alias("strength"))


@register(_E + """,
c AS (SELECT user_id, t, t / 1e6 AS s, lead(t) OVER w / 1e6 AS s2, 3600 / nullif((lead(t) OVER w - t) / 1e6, 0) AS tempo FROM e WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, count(tempo) AS n, round(avg(tempo), 6) AS mean, round(min(tempo), 6) AS slowest FROM c GROUP BY 1
""")
def tempo_curve(spark: SparkSession, d: str) -> DataFrame:
    """Views an hour from the intervals between a user's views."""
    gap = (F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")) - F.col("t")) / 1e6
    c = events(spark, d, "view").select("user_id", (3600 / F.nullif(gap, F.lit(0.0))).alias("tempo"))
    return c.groupBy("user_id").agg(F.count("tempo").alias("n"), r6(F.avg("tempo")).alias("mean"), r6(F.min("tempo")).alias("slowest"))


@register(_E + """,
b AS (SELECT user_id, t // 86400000000 AS bar, avg(value) AS mean, count(*) AS n FROM e GROUP BY 1, 2), g AS (SELECT user_id, unnest(range(min(bar), max(bar) + 1)) AS bar FROM b GROUP BY 1)
SELECT g.user_id, g.bar, coalesce(n, 0) AS n, round(coalesce(mean, last_value(mean IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.bar ROWS UNBOUNDED PRECEDING)), 6) AS mean FROM g LEFT JOIN b USING (user_id, bar)
""")
def bar_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean of a user's values in each daily bar; an empty bar takes the one before."""
    b = events(spark, d).groupBy("user_id", F.floor(F.col("t") / (24 * HOUR)).alias("bar")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    g = b.groupBy("user_id").agg(F.min("bar").alias("a"), F.max("bar").alias("z")).select("user_id", F.explode(F.sequence("a", "z")).alias("bar"))
    w = Window.partitionBy("user_id").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    return g.join(b, ["user_id", "bar"], "left").select("user_id", "bar", F.coalesce("n", F.lit(0)).alias("n"), r6(F.coalesce("mean", F.last("mean", True).over(w))).alias("mean"))


@register("""
WITH f AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), k AS (SELECT o_custkey, max(n) FILTER (o_orderstatus = 'F') AS f, max(n) FILTER (o_orderstatus = 'O') AS o, max(n) FILTER (o_orderstatus = 'P') AS p FROM f GROUP BY 1)
SELECT verdict, count(*) AS customers FROM (SELECT CASE WHEN p IS NOT NULL AND f IS NULL THEN 'dead-moved' WHEN f > coalesce(o, 0) THEN 'live-moved' WHEN o IS NOT NULL THEN 'live-not-seen' ELSE 'untested' END AS verdict FROM k) GROUP BY 1
""")
def evidence_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict ladder over each customer's status counts."""
    k = table(spark, d, "orders").groupBy("o_custkey").agg(*[F.nullif(F.count_if(F.col("o_orderstatus") == s), F.lit(0).cast("long")).alias(s.lower()) for s in "FOP"])
    v = F.when(F.col("p").isNotNull() & F.col("f").isNull(), "dead-moved").when(F.col("f") > F.coalesce("o", F.lit(0)), "live-moved").when(F.col("o").isNotNull(), "live-not-seen").otherwise("untested")
    return k.groupBy(v.alias("verdict")).agg(F.count("*").alias("customers"))


@register("WITH m AS (SELECT text AS fault, count(*) AS n FROM conversations GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, fault) AS k FROM m) SELECT fault, n FROM k WHERE k <= 10")
def common_faults(spark: SparkSession, d: str) -> DataFrame:
    """Ten commonest messages (a top-k report)."""
    m = table(spark, d, "conversations").groupBy(F.col("text").alias("fault")).agg(F.count("*").alias("n"))
    return m.orderBy(F.desc("n"), "fault").limit(10)


_CRITICAL = normal_quantile(1 - 0.05 / (2 * 150))


@register(_E + f""",
s AS (SELECT user_id, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM e GROUP BY 1), g AS (SELECT avg(value) AS g FROM e)
SELECT user_id, n, round((m - g) / (s / sqrt(n)), 5) AS z, abs((m - g) / (s / sqrt(n))) > {_CRITICAL!r} AS moved, cast(ceil(({_CRITICAL!r} * s / 5) ** 2) AS BIGINT) AS needed FROM s CROSS JOIN g WHERE n > 1
""")
def detectable_moves(spark: SparkSession, d: str) -> DataFrame:
    """Which users move off the overall mean under a Bonferroni bound, and the samples a move of 5 would need."""
    e = events(spark, d)
    s = e.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where("n > 1")
    z = (F.col("m") - F.col("g")) / (F.col("s") / F.sqrt("n"))
    return s.join(F.broadcast(e.agg(F.avg("value").alias("g")))).select("user_id", "n", F.round(z, 5).alias("z"), (F.abs(z) > _CRITICAL).alias("moved"), F.ceil((F.lit(_CRITICAL) * F.col("s") / 5) ** 2).cast("long").alias("needed"))


@register(_E + """,
x AS (SELECT user_id, event_id, t, value, median(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m FROM e)
SELECT event_id, round(value - m, 6) AS step FROM x WHERE m IS NOT NULL
""")
def step_differences(spark: SparkSession, d: str) -> DataFrame:
    """Each value less the median of the five before it."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(-5, -1)
    seen = events(spark, d).select("event_id", "value", F.array_sort(F.collect_list("value").over(w)).alias("v")).where(F.size("v") > 0)
    n = F.size("v")
    middle = (F.get("v", F.floor((n - 1) / 2).cast("int")) + F.get("v", F.floor(n / 2).cast("int"))) / 2
    return seen.select("event_id", r6(F.col("value") - middle).alias("step"))


@register("""
WITH x AS (SELECT p_brand, p_size, avg(p_retailprice) AS y FROM part GROUP BY 1, 2), s AS (SELECT p_brand, p_size, sign(y - lag(y) OVER (PARTITION BY p_brand ORDER BY p_size)) AS s FROM x), m AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY p_brand ORDER BY p_size) = s THEN 0 ELSE 1 END AS n FROM s WHERE s IS NOT NULL),
i AS (SELECT *, sum(n) OVER (PARTITION BY p_brand ORDER BY p_size ROWS UNBOUNDED PRECEDING) AS i FROM m), r AS (SELECT p_brand, i, s, count(*) AS length, min(p_size) AS first, max(p_size) AS last FROM i GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length DESC, i) AS k FROM r)
SELECT p_brand, cast(s AS INT) AS s, length, first, last FROM k WHERE k = 1
""")
def monotonic_segment(spark: SparkSession, d: str) -> DataFrame:
    """Longest stretch of a brand's price curve that keeps rising or falling."""
    x = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("y"))
    s = F.signum(F.col("y") - F.lag("y").over(Window.partitionBy("p_brand").orderBy("p_size"))).cast("int")
    return windows.longest_run(x.withColumn("s", s).where("s is not null"), key=["p_brand"], order=["p_size"], same="s")


@register("""
WITH e AS (SELECT label, vec_id, unnest(cast(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2), r AS (SELECT vec_id, e.label, sqrt(sum((x - m) ** 2)) AS r FROM e JOIN m USING (label, i) GROUP BY 1, 2)
SELECT label, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS spread FROM r GROUP BY 1
""")
def label_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Distance of vectors from the mean of their label."""
    e = table(spark, d, "embeddings").select("label", "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg("x").alias("m"))
    r = e.join(m, ["label", "i"]).groupBy("vec_id", "label").agg(F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2)).alias("r"))
    return r.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("r")).alias("mean"), r6(F.stddev_pop("r")).alias("spread"))


@register("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS state FROM lineitem), p AS (SELECT *, lead(state) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, state) AS n FROM s)
SELECT state AS f, n AS t, count(*) AS steps FROM p WHERE n IS NOT NULL GROUP BY 1, 2
""")
def state_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps between consecutive states: from, to and how often."""
    s = F.concat("l_returnflag", "l_linestatus")
    n = F.lead("state").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "state"))
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("state")).withColumn("n", n).where("n is not null")
    return p.groupBy(F.col("state").alias("f"), F.col("n").alias("t")).agg(F.count("*").alias("steps"))


@register("""
WITH m AS (SELECT conv_id, turn, role, text FROM conversations), a AS (SELECT conv_id, count(*) AS turns, max(turn) AS last, count(DISTINCT role) AS roles, arg_min(role, turn) AS opened FROM m GROUP BY 1)
SELECT turns, roles, opened, count(*) AS conversations FROM a GROUP BY 1, 2, 3
""")
def conversation_shapes(spark: SparkSession, d: str) -> DataFrame:
    """How conversations open and how long they run."""
    a = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), F.min_by("role", "turn").alias("opened"))
    return a.groupBy("turns", "roles", "opened").agg(F.count("*").alias("conversations"))
