"""Archive and log queries: commits, checks, renumbering, documents, and what each capture or write belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6, table

HOUR = 3_600_000_000
DAY = 24 * HOUR
_E = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events)"


@register("SELECT l_orderkey AS frame, l_returnflag AS program, CASE WHEN l_discount = 0 THEN -1 ELSE cast(round(l_discount * 100) AS INT) END AS setpoint, coalesce(CASE WHEN l_tax > 0 THEN round(l_extendedprice, 4) END, 0.0) AS captured, coalesce(CASE WHEN l_linestatus = 'F' THEN l_linenumber END, -1) AS shown, coalesce(CASE WHEN l_quantity > 25 THEN cast(l_quantity AS INT) END, 0) AS ambiguity FROM lineitem")
def frame_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines as frame rows read with their defaults: no capture time, not shown, not ambiguous, a gap."""
    setpoint = F.when(F.col("l_discount") == 0, -1).otherwise(F.round(F.col("l_discount") * 100).cast("int"))
    sparse = {"captured": (F.when(F.col("l_tax") > 0, F.round("l_extendedprice", 4)), 0.0), "shown": (F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")), -1), "ambiguity": (F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("int")), 0)}
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("program"), setpoint.alias("setpoint"), *[F.coalesce(c, F.lit(v)).alias(name) for name, (c, v) in sparse.items()])


@register("""
WITH k AS (SELECT l_returnflag, l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_linestatus) AS states FROM lineitem GROUP BY 1, 2, 3)
SELECT l_returnflag AS program, cast(sum(n) AS BIGINT) AS rows, cast(sum(n - 1) AS BIGINT) AS repeated, count(*) FILTER (states > 1) AS mixed, cast(sum(n) AS BIGINT) > 0 AND sum(n - 1) = 0 AND count(*) FILTER (states > 1) = 0 AS accepted FROM k GROUP BY 1
""")
def archive_checks(spark: SparkSession, d: str) -> DataFrame:
    """What keeps a program's frames from being committed: repeated frame numbers and frames of mixed order."""
    k = table(spark, d, "lineitem").groupBy("l_returnflag", "l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_distinct("l_linestatus").alias("states"))
    c = k.groupBy(F.col("l_returnflag").alias("program")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated"), F.count_if(F.col("states") > 1).alias("mixed"))
    return c.withColumn("accepted", (F.col("rows") > 0) & (F.col("repeated") == 0) & (F.col("mixed") == 0))


@register("""
WITH b AS (SELECT o_custkey, min(o_totalprice) AS least, max(o_orderdate) AS at FROM orders GROUP BY 1), u AS (SELECT o_custkey, count(*) AS dark FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT b.o_custkey, coalesce(dark, 0) AS dark, CASE WHEN dark IS NULL THEN 'base,least' ELSE 'base,dark,least' END AS fields, round(least, 4) AS least FROM b LEFT JOIN u USING (o_custkey)
""")
def annotated_commits(spark: SparkSession, d: str) -> DataFrame:
    """Commit metadata of each customer with the dark verdicts merged in as further fields."""
    o = table(spark, d, "orders")
    base = o.groupBy("o_custkey").agg(F.create_map(F.lit("base"), F.lit(1.0), F.lit("least"), F.min("o_totalprice")).alias("meta"))
    dark = o.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.create_map(F.lit("dark"), F.count("*").cast("double")).alias("more"))
    m = base.join(dark, "o_custkey", "left").withColumn("meta", F.when(F.col("more").isNull(), F.col("meta")).otherwise(F.map_concat("meta", "more")))
    return m.select("o_custkey", F.coalesce(F.col("meta")["dark"], F.lit(0.0)).cast("long").alias("dark"), F.array_join(F.array_sort(F.map_keys("meta")), ",").alias("fields"), F.round(F.col("meta")["least"], 4).alias("least"))


@register("""
WITH p AS (SELECT 0 AS scan, c_nationkey AS id, c_name AS name FROM customer UNION ALL SELECT 1, s_nationkey, s_name FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scan, name) AS k, count(*) OVER (PARTITION BY id) AS n FROM p)
SELECT cast(id AS INT) AS id, name, scan, n, n = 1 AS resolved FROM k WHERE k = 1
""")
def library_programs(spark: SparkSession, d: str) -> DataFrame:
    """First package of each id in scan order over two places, and whether the id is named once."""
    p = table(spark, d, "customer").select(F.lit(0).alias("scan"), F.col("c_nationkey").alias("id"), F.col("c_name").alias("name")).unionByName(table(spark, d, "supplier").select(F.lit(1).alias("scan"), F.col("s_nationkey").alias("id"), F.col("s_name").alias("name")))
    g = p.groupBy("id").agg(F.min(F.struct("scan", "name")).alias("f"), F.count("*").alias("n"))
    return g.select(F.col("id").cast("int").alias("id"), "f.name", "f.scan", "n", (F.col("n") == 1).alias("resolved"))


@register(_E + """,
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, t // 86400000000 ORDER BY t, event_id) AS k FROM e), a AS (SELECT * FROM k WHERE k = 1), l AS (SELECT max(value) AS longest FROM a)
SELECT user_id, count(*) AS appended, round(max(value), 6) AS longest, round(coalesce(max(value) FILTER (event_type = 'error'), any_value(longest)), 6) AS guard FROM a CROSS JOIN l GROUP BY 1
""")
def appended_loads(spark: SparkSession, d: str) -> DataFrame:
    """Loads appended once a (user, day), the longest of a user, and a stall guard that falls back to the longest of all."""
    first = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("t", "event_id"))
    a = events(spark, d).withColumn("day", F.floor(F.col("t") / DAY)).withColumn("k", first).where("k = 1")
    own = a.groupBy("user_id").agg(F.count("*").alias("appended"), F.max("value").alias("longest"), F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("stall"))
    every = a.agg(F.max("value").alias("all"))  # one row
    return own.join(F.broadcast(every)).select("user_id", "appended", r6("longest").alias("longest"), r6(F.coalesce("stall", "all")).alias("guard"))


@register("""
WITH p AS (SELECT o_orderpriority AS program, o_orderstatus AS part, count(*) AS n FROM orders GROUP BY 1, 2), f AS (SELECT *, cast(sum(n) OVER (PARTITION BY program ORDER BY part ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS base FROM p),
k AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey, base + i AS frame FROM k JOIN f ON program = o_orderpriority AND part = o_orderstatus
""")
def renumbered_parts(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a program's parts numbered on from part to part; rows of a part are numbered in ranges of their key."""
    o, width, by = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), 65_536, ["o_orderpriority", "o_orderstatus"]
    o = o.withColumn("_b", F.floor(F.col("o_orderkey") / width))
    sizes = o.groupBy(*by, "_b").agg(F.count("*").alias("n"))
    base = F.sum("n").over(Window.partitionBy("o_orderpriority").orderBy("o_orderstatus", "_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    within = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("o_orderkey")) - 1
    return o.withColumn("i", within).join(sizes.withColumn("base", base), [*by, "_b"]).select("o_orderkey", (F.col("base") + F.col("i")).alias("frame"))


@register(_E + """,
p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, event_type FROM e), w AS (SELECT DISTINCT user_id, n, unnest([0, 1, 2, 3]) AS s FROM p),
c AS (SELECT w.user_id, s, min(p.i) AS start FROM w JOIN p ON p.user_id = w.user_id AND p.event_type = 'view' AND p.i >= w.n * w.s // 4 GROUP BY 1, 2)
SELECT DISTINCT user_id, start FROM c
""")
def keyframe_segments(spark: SparkSession, d: str) -> DataFrame:
    """Up to four near-equal segments of a user's events, each from the next view on."""
    w = Window.partitionBy("user_id")
    p = events(spark, d).select("user_id", (F.row_number().over(w.orderBy("t", "event_id")) - 1).alias("i"), F.count("*").over(w).alias("n"), "event_type").where("event_type = 'view'")
    starts = p.groupBy("user_id").agg(*[F.min(F.when(F.col("i") >= F.expr(f"n * {s} div 4"), F.col("i"))).alias(f"s{s}") for s in range(4)])
    return starts.select("user_id", F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(f"s{s}").cast("long") for s in range(4)])))).alias("start"))


@register(_E + """,
g AS (SELECT user_id, event_type, t - lag(t) OVER w AS gap, lag(event_type) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, count(*) AS flips, count(*) FILTER (before IS NULL OR gap > 43200000000) AS segments, count(*) FILTER (gap < 60000000) AS fast, count(*) FILTER (gap > 21600000000 AND event_type = before) AS stuck FROM g GROUP BY 1
""")
def flip_summary(spark: SparkSession, d: str) -> DataFrame:
    """Flips, segments and flips out of cadence of each user."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    g = events(spark, d).select("user_id", "event_type", (F.col("t") - F.lag("t").over(w)).alias("gap"), F.lag("event_type").over(w).alias("before"))
    return g.groupBy("user_id").agg(F.count("*").alias("flips"), F.count_if(F.col("before").isNull() | (F.col("gap") > 12 * HOUR)).alias("segments"), F.count_if(F.col("gap") < 60_000_000).alias("fast"), F.count_if((F.col("gap") > 6 * HOUR) & (F.col("event_type") == F.col("before"))).alias("stuck"))


@register("SELECT event_id, coalesce(cast(json_extract(props, '$.o') AS INT), cast(json_extract(props, '$.out') AS INT), cast(json_extract(props, '$.k') AS INT)) AS first, coalesce(cast(json_extract(props, '$.k') AS INT), 0) || ',0,0' AS vector FROM events")
def combined_values(spark: SparkSession, d: str) -> DataFrame:
    """First present key of a status reply, and its values as a vector of slots."""
    p = table(spark, d, "events").select("event_id", F.from_json("props", "o int, out int, k int").alias("p"))
    return p.select("event_id", F.coalesce("p.o", "p.out", "p.k").alias("first"), F.array_join(F.array(F.coalesce("p.k", F.lit(0)), F.lit(0), F.lit(0)), ",").alias("vector"))


@register("""
WITH o AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS states FROM orders GROUP BY 1)
SELECT o_custkey, n AS sections, total, states, 'none' AS mode FROM o
""")
def score_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as one JSON document, parsed back with a default for what it lacks."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price")))).alias("sections"))
    kind = "struct<sections: array<struct<o_orderkey: bigint, o_orderstatus: string, price: double>>, mode: string>"
    p = o.select("o_custkey", F.from_json(F.to_json(F.struct("sections")), kind).alias("p"))
    total = F.aggregate("p.sections", F.lit(0.0), lambda a, x: a + x["price"])
    return p.select("o_custkey", F.size("p.sections").cast("long").alias("sections"), F.round(total, 2).alias("total"), F.array_join(F.transform("p.sections", lambda x: x["o_orderstatus"]), "").alias("states"), F.coalesce("p.mode", F.lit("none")).alias("mode"))


@register("SELECT doc_id % 100 AS take, string_agg('file ''' || doc_id || '''' || chr(10) || 'duration ' || n_chars, chr(10) ORDER BY doc_id) AS listing FROM documents GROUP BY 1")
def part_listings(spark: SparkSession, d: str) -> DataFrame:
    """Listing of each take's parts with their durations, in order."""
    line = F.concat(F.lit("file '"), F.col("doc_id").cast("string"), F.lit("'\nduration "), F.col("n_chars").cast("string"))
    parts = table(spark, d, "documents").groupBy((F.col("doc_id") % 100).alias("take")).agg(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("l")))).alias("p"))
    return parts.select("take", F.array_join(F.transform("p", lambda x: x["l"]), "\n").alias("listing"))


@register(_E + """,
c AS (SELECT user_id, event_id, t, (t // 3600000000) % 24 AS code FROM e), n AS (SELECT *, (code - lag(code) OVER w + 24) % 24 = 1 AS next, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS island FROM n WHERE next)
SELECT user_id, min(k) - 1 AS start, count(*) + 1 AS length FROM s GROUP BY user_id, island
""")
def code_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Stretches in which consecutive captures show consecutive codes (hours of the day)."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    c = events(spark, d).withColumn("code", F.floor(F.col("t") / HOUR) % 24)
    n = c.select("user_id", (F.pmod(F.col("code") - F.lag("code").over(w), F.lit(24)) == 1).alias("next"), F.row_number().over(w).cast("long").alias("k")).where("next")
    island = F.col("k") - F.row_number().over(Window.partitionBy("user_id").orderBy("k"))
    return n.withColumn("island", island).groupBy("user_id", "island").agg((F.min("k") - 1).alias("start"), (F.count("*") + 1).alias("length")).drop("island")


@register(_E + """,
v AS (SELECT user_id, event_id, t FROM e WHERE event_type = 'view'), s AS (SELECT user_id, t FROM e WHERE event_type = 'signup')
SELECT v.event_id, coalesce((s.t - v.t) / 1e6, cast('inf' AS DOUBLE)) AS wait, s.t IS NOT NULL AND s.t - v.t <= 86400000000 AS heard FROM v ASOF LEFT JOIN s ON v.user_id = s.user_id AND v.t <= s.t
""")
def shown_at(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from each view to the next signup of its user, infinite where none follows, and whether it comes within a day."""
    found = joins.asof(events(spark, d, "view"), events(spark, d, "signup").withColumn("at", F.col("t")), key=["user_id"], time="t", values=["at"], tie="event_id", forward=True, strict=False)
    wait = F.col("r_at") - F.col("t")
    return found.select("event_id", F.coalesce(wait / 1e6, F.lit(float("inf"))).alias("wait"), F.coalesce(wait <= DAY, F.lit(False)).alias("heard"))


@register("""
WITH g AS (SELECT l_partkey, l_suppkey, l_quantity, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT l_suppkey, count(*) AS groups, cast(sum(n) AS BIGINT) AS rows, max(n) AS most, min(first) AS first FROM g GROUP BY 1
""")
def shared_keys(spark: SparkSession, d: str) -> DataFrame:
    """Settings that more than one line has, by supplier."""
    g = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey", "l_quantity").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first")).where("n > 1")
    return g.groupBy("l_suppkey").agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.max("n").alias("most"), F.min("first").alias("first"))


@register(_E + """,
s AS (SELECT user_id, t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS send FROM e WHERE event_type = 'click'), m AS (SELECT user_id, min(t) AS a, max(t) AS b FROM e WHERE event_type = 'purchase' GROUP BY 1),
o AS (SELECT s.user_id, send, row_number() OVER (PARTITION BY s.user_id ORDER BY s.t, event_id) AS own FROM s JOIN m ON m.user_id = s.user_id AND s.t >= a AND s.t < b)
SELECT user_id, send, own FROM o
""")
def own_wire(spark: SparkSession, d: str) -> DataFrame:
    """Sends of a user that fall inside its take (first to last purchase), renumbered."""
    e, w = events(spark, d), Window.partitionBy("user_id").orderBy("t", "event_id")
    s = e.where("event_type = 'click'").withColumn("send", F.row_number().over(w).cast("long"))
    m = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return s.join(m, "user_id").where("t >= a and t < b").select("user_id", "send", F.row_number().over(w).cast("long").alias("own"))


@register("""
WITH o AS (SELECT o_custkey, count(*) AS gestures, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1), l AS (SELECT o_custkey, count(*) AS writes, cast(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS landed FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, coalesce(gestures, 0) AS gestures, coalesce(kinds, 0) AS kinds, coalesce(writes, 0) AS writes, coalesce(landed, 0) AS landed, CASE WHEN gestures IS NULL THEN 'silent' WHEN writes IS NULL THEN 'unplanned' WHEN landed < writes THEN 'partial' ELSE 'complete' END AS verdict FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey
""")
def gesture_audit(spark: SparkSession, d: str) -> DataFrame:
    """Gestures of each customer against the writes planned for them and those that landed."""
    orders = table(spark, d, "orders")
    o = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("gestures"), F.count_distinct("o_orderpriority").alias("kinds"))
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    w = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("n").alias("writes"), F.sum("f").alias("landed"))
    a = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").join(w, "c_custkey", "left")
    verdict = F.when(F.col("gestures").isNull(), "silent").when(F.col("writes").isNull(), "unplanned").when(F.col("landed") < F.col("writes"), "partial").otherwise("complete")
    return a.select("c_custkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gestures", "kinds", "writes", "landed")], verdict.alias("verdict"))


@register(_E + """,
w AS (SELECT user_id, t AS opens, t + 21600000000 AS closes, event_id AS output FROM e WHERE event_type = 'signup')
SELECT w.output, count(e.event_id) AS captures, round(sum(e.value), 4) AS total FROM w LEFT JOIN e ON e.user_id = w.user_id AND e.t >= w.opens AND e.t < w.closes GROUP BY 1
""")
def routed_captures(spark: SparkSession, d: str) -> DataFrame:
    """Captures routed to every output whose window [opens, closes) holds their time."""
    e = events(spark, d)
    w = e.where("event_type = 'signup'").select("user_id", F.col("t").alias("opens"), (F.col("t") + 6 * HOUR - 1).alias("closes"), F.col("event_id").alias("output"))
    hit = joins.interval_join(e.select("user_id", "t", "value"), w, time="t", start="opens", end="closes", width=6 * HOUR, key=["user_id"]).groupBy("output").agg(F.count("*").alias("captures"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("output").join(hit, "output", "left").select("output", F.coalesce("captures", F.lit(0)).alias("captures"), "total")


@register(_E + """,
s AS (SELECT user_id, event_id, value AS x, lag(value) OVER w AS y, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
r AS (SELECT event_id, user_id, k AS n, sum(x) OVER a AS sx, sum(x * x) OVER a AS sxx, sum(x * y) OVER a AS sxy, first_value(x) OVER a AS f, x AS l FROM s WINDOW a AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT event_id, n, round(CASE WHEN n > 2 AND sxx - sx * sx / n > 1e-9 THEN (sxy - (sx / n) * (2 * sx - f - l) + (n - 1) * (sx / n) * (sx / n)) / (sxx - sx * sx / n) ELSE 0 END, 5) AS lag1, round(CASE WHEN n > 3 THEN tanh(1.96 / sqrt(n - 3)) END, 6) AS least FROM r
""")
def growing_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    """Lag-1 autocorrelation of every prefix of a user's values from running sums, and the least correlation that prefix can detect."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    a = w.rowsBetween(Window.unboundedPreceding, 0)
    s = events(spark, d).withColumn("x", F.col("value")).withColumn("y", F.lag("value").over(w))
    r = s.select("event_id", F.row_number().over(w).cast("long").alias("n"), F.sum("x").over(a).alias("sx"), F.sum(F.col("x") * F.col("x")).over(a).alias("sxx"), F.sum(F.col("x") * F.col("y")).over(a).alias("sxy"), F.first("x").over(a).alias("f"), F.col("x").alias("l"))
    mean, spread = F.col("sx") / F.col("n"), F.expr("sxx - sx * sx / n")
    lag1 = (F.col("sxy") - mean * (2 * F.col("sx") - F.col("f") - F.col("l")) + (F.col("n") - 1) * mean * mean) / spread
    return r.select("event_id", "n", F.round(F.when((F.col("n") > 2) & (spread > 1e-9), lag1).otherwise(0.0), 5).alias("lag1"), r6(F.when(F.col("n") > 3, F.tanh(1.96 / F.sqrt(F.col("n") - 3)))).alias("least"))


@register(_E + """,
g AS (SELECT user_id, unnest(range(min(t) // 21600000000 + 1, max(t) // 21600000000 + 1)) * 21600000000 AS mark FROM e GROUP BY 1),
b AS (SELECT g.user_id, g.mark, e.t AS t0, e.value AS v0 FROM g ASOF LEFT JOIN e ON g.user_id = e.user_id AND g.mark >= e.t), f AS (SELECT b.*, e.t AS t1, e.value AS v1 FROM b ASOF LEFT JOIN e ON b.user_id = e.user_id AND b.mark <= e.t),
l AS (SELECT user_id, mark, CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (mark - t0) / cast(t1 - t0 AS DOUBLE) END AS v FROM f), m AS (SELECT *, avg(v) OVER (PARTITION BY user_id) AS m, stddev_pop(v) OVER (PARTITION BY user_id) AS s FROM l)
SELECT user_id, mark, round(v, 6) AS value, round(CASE WHEN s > 1e-12 THEN (v - m) / s ELSE v END, 5) AS standard FROM m
""")
def resampled_series(spark: SparkSession, d: str) -> DataFrame:
    """Values of a user on a six-hour grid by linear interpolation between the neighbours, standardised."""
    e = events(spark, d)
    step = 6 * HOUR
    g = e.groupBy("user_id").agg((F.floor(F.min("t") / step) + 1).alias("a"), F.floor(F.max("t") / step).alias("b")).where("a <= b").select("user_id", F.explode(F.transform(F.sequence("a", "b"), lambda h: h * step)).alias("t"))
    known = e.withColumn("at", F.col("t"))
    before = joins.asof(g, known, key=["user_id"], time="t", values=["at", "value"], tie="event_id", strict=False).withColumnsRenamed({"r_at": "t0", "r_value": "v0"})
    both = joins.asof(before, known, key=["user_id"], time="t", values=["at", "value"], tie="event_id", forward=True, strict=False)
    v = F.when(F.col("r_at") == F.col("t0"), F.col("v0")).otherwise(F.col("v0") + (F.col("r_value") - F.col("v0")) * (F.col("t") - F.col("t0")) / (F.col("r_at") - F.col("t0")).cast("double"))
    w = Window.partitionBy("user_id")
    m = both.select("user_id", F.col("t").alias("mark"), v.alias("v")).withColumn("m", F.avg("v").over(w)).withColumn("s", F.stddev_pop("v").over(w))
    return m.select("user_id", "mark", r6("v").alias("value"), F.round(F.when(F.col("s") > 1e-12, (F.col("v") - F.col("m")) / F.col("s")).otherwise(F.col("v")), 5).alias("standard"))


@register(_E + """,
a AS (SELECT event_id, (t % 86400000000) / 86400000000.0 * 2 * pi() + value AS a FROM e)
SELECT event_id, round(atan2(sin(a), cos(a)), 6) AS wrapped, cast(((cast(round_even(a / (2 * pi()) * 24, 0) AS BIGINT) % 24) + 24) % 24 AS BIGINT) AS slot, round(a / (2 * pi()) * 24 - round_even(a / (2 * pi()) * 24, 0), 5) AS rest, cast(least(127, floor((a - floor(a / (2 * pi())) * 2 * pi()) / (2 * pi()) * 128)) * 32 + 7 AS BIGINT) AS cell FROM a
""")
def wrapped_angles(spark: SparkSession, d: str) -> DataFrame:
    """Angles wrapped to (-pi, pi], their grid positions, what is left of a step, and the cell of a phase table."""
    turn = 2 * F.pi()
    a = (F.col("t") % DAY) / F.lit(float(DAY)) * turn + F.col("value")
    s = events(spark, d).select("event_id", a.alias("a"), (a / turn * 24).alias("g"))
    phase = (F.col("a") - F.floor(F.col("a") / turn) * turn) / turn
    return s.select("event_id", r6(F.atan2(F.sin("a"), F.cos("a"))).alias("wrapped"), F.pmod(F.rint("g").cast("long"), F.lit(24)).alias("slot"), F.round(F.col("g") - F.rint("g"), 5).alias("rest"), (F.least(F.lit(127), F.floor(phase * 128)) * 32 + 7).alias("cell"))
