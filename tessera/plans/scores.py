"""Score and automation queries: sections, gestures, merged and staggered plans, parameter kinds and clock arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6, table

HOUR = 3_600_000_000
DAY = 24 * HOUR
_E = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events)"


@register(_E + """,
s AS (SELECT user_id, event_id AS section, t AS a, t + 86400000000 AS b, value >= 50 AS destroy FROM e WHERE event_type = 'signup')
SELECT e.event_id, arg_min(s.section, (s.a, s.section)) AS section, coalesce(bool_or(s.destroy), false) AS destroyed FROM e LEFT JOIN s ON s.user_id = e.user_id AND e.t >= s.a AND e.t < s.b WHERE e.event_type <> 'signup' GROUP BY 1
""")
def section_at(spark: SparkSession, d: str) -> DataFrame:
    """First section (the day after a signup) that holds each event, and whether a destroying one does."""
    e = events(spark, d)
    s = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("section"), F.col("t").alias("a"), (F.col("t") + DAY - 1).alias("b"), (F.col("value") >= 50).alias("destroy"))
    rest = e.where("event_type <> 'signup'").select("event_id", "user_id", "t")
    hit = joins.interval_join(rest, s, time="t", start="a", end="b", width=DAY, key=["user_id"]).groupBy("event_id").agg(F.min_by("section", F.struct("a", "section")).alias("section"), F.bool_or("destroy").alias("destroyed"))
    return rest.select("event_id").join(hit, "event_id", "left").select("event_id", "section", F.coalesce("destroyed", F.lit(False)).alias("destroyed"))


@register("""
WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders), p AS (SELECT n_name AS name, n_nationkey AS k FROM nation), n AS (SELECT count(*) AS n FROM nation)
SELECT o_orderkey, i, name AS program FROM s CROSS JOIN n JOIN p ON p.k = s.i % n.n
""")
def cut_plan(spark: SparkSession, d: str) -> DataFrame:
    """Sections of each customer dealt to the programs in turn."""
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long") - 1
    s = table(spark, d, "orders").select("o_orderkey", i.alias("i"))
    programs = table(spark, d, "nation").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda p: p["n_name"]).alias("p"))  # one row: the programs on hand
    return s.join(F.broadcast(programs)).select("o_orderkey", "i", F.get("p", (F.col("i") % F.size("p")).cast("int")).alias("program"))


@register(_E + """,
p AS (SELECT 0 AS part, user_id, event_id, t, value FROM e WHERE event_type = 'click' UNION ALL SELECT 1, user_id, event_id, t + 1800000000, value FROM e WHERE event_type = 'view'),
w AS (SELECT p.*, min(t) OVER (PARTITION BY user_id) AS z FROM p)
SELECT user_id, part, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, part, event_id) AS place FROM w WHERE t >= z + 86400000000 AND t < z + 15 * 86400000000
""")
def merged_automation(spark: SparkSession, d: str) -> DataFrame:
    """Two parts merged in stable time order, the second moved by half an hour, cut to a half-open span of two weeks."""
    e = events(spark, d)
    parts = e.where("event_type = 'click'").withColumn("part", F.lit(0)).unionByName(e.where("event_type = 'view'").withColumn("part", F.lit(1)).withColumn("t", F.col("t") + HOUR // 2))
    first = F.min("t").over(Window.partitionBy("user_id"))
    cut = parts.withColumn("z", first).where((F.col("t") >= F.col("z") + DAY) & (F.col("t") < F.col("z") + 15 * DAY))
    return cut.select("user_id", "part", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "part", "event_id")).cast("long").alias("place"))


@register("""
WITH p AS (SELECT p_partkey, p_partkey % 5 AS kind, p_size AS lo, 1023 - p_size * 5 AS hi FROM part),
g AS (SELECT p_partkey, kind, unnest(range(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 9 WHEN 2 THEN 2 WHEN 3 THEN 9 ELSE 1 END)) AS i, lo, hi FROM p)
SELECT p_partkey, i, CASE kind WHEN 0 THEN 'hold' WHEN 1 THEN 'ramp' WHEN 2 THEN 'punch' WHEN 3 THEN 'loop' ELSE 'snap' END AS gesture,
cast(CASE kind WHEN 0 THEN lo WHEN 1 THEN round_even(lo + (hi - lo) * i / 8.0, 0) WHEN 2 THEN CASE WHEN i = 0 THEN hi ELSE lo END WHEN 3 THEN round_even(lo + (hi - lo) * (4 - abs(4 - i)) / 4.0, 0) ELSE (lo + hi) // 2 END AS BIGINT) AS value FROM g
""")
def rendered_gestures(spark: SparkSession, d: str) -> DataFrame:
    """Gestures of parts as writes on a control grid: hold, ramp, punch, up-and-down loop and snap to the middle."""
    kind = F.col("p_partkey") % 5
    p = table(spark, d, "part").select("p_partkey", kind.alias("kind"), F.col("p_size").alias("lo"), (1023 - F.col("p_size") * 5).alias("hi"))
    last = F.when(F.col("kind").isin(1, 3), 8).when(F.col("kind") == 2, 1).otherwise(0)
    g = p.withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    lo, reach, i = F.col("lo"), F.col("hi") - F.col("lo"), F.col("i")
    value = F.when(F.col("kind") == 0, lo).when(F.col("kind") == 1, F.rint(lo + reach * i / 8.0)).when(F.col("kind") == 2, F.when(i == 0, F.col("hi")).otherwise(lo)).when(F.col("kind") == 3, F.rint(lo + reach * (4 - F.abs(4 - i)) / 4.0)).otherwise(F.expr("(lo + hi) div 2"))
    name = F.element_at(F.array(*map(F.lit, ("hold", "ramp", "punch", "loop", "snap"))), (F.col("kind") + 1).cast("int"))
    return g.select("p_partkey", F.col("i").cast("long").alias("i"), name.alias("gesture"), value.cast("long").alias("value"))


@register("""
WITH s AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, [cast(l_quantity AS BIGINT), cast(round(l_discount * 100) AS BIGINT), cast(round(l_tax * 100) AS BIGINT)] AS v FROM lineitem),
c AS (SELECT *, lag(v) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, v) AS b FROM s), u AS (SELECT rid, l_orderkey, l_linenumber, unnest(range(3)) AS slot, unnest(v) AS v, unnest(coalesce(b, [-1, -1, -1])) AS b FROM c),
k AS (SELECT rid, l_orderkey, l_linenumber, slot, v FROM u WHERE v <> b)
SELECT l_orderkey, l_linenumber, slot, v AS value, row_number() OVER (PARTITION BY rid ORDER BY slot) - 1 AS frame FROM k
""")
def staggered_plan(spark: SparkSession, d: str) -> DataFrame:
    """Settings of an order's lines as one write a changed slot and frame."""
    hundredths = lambda c: F.round(F.col(c) * 100).cast("long")
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity").cast("long"), hundredths("l_discount"), hundredths("l_tax")).alias("v"))
    before = F.coalesce(F.lag("v").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "v")), F.array(*[F.lit(-1).cast("long")] * 3))
    writes = F.filter(F.zip_with("v", F.sequence(F.lit(0), F.lit(2)), lambda v, i: F.struct(i.alias("slot"), v.alias("value"), F.get("b", i).alias("was"))), lambda w: w["value"] != w["was"])
    frames = F.posexplode(writes).alias("frame", "w")
    return s.withColumn("b", before).select("l_orderkey", "l_linenumber", frames).select("l_orderkey", "l_linenumber", F.col("w.slot").cast("long").alias("slot"), F.col("w.value").alias("value"), F.col("frame").cast("long").alias("frame"))


@register("""
WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(floor(o_totalprice / 50000)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b, floor(o_totalprice / 50000) AS v FROM orders)
SELECT o_orderkey, cast(v AS BIGINT) AS level FROM c WHERE b IS NULL OR b <> v
""")
def carried_setpoints(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose price level differs from the one before: setpoints that repeat after snapping are dropped."""
    v = F.floor(F.col("o_totalprice") / 50_000)
    before = F.lag("v").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").withColumn("v", v).withColumn("b", before).where("b is null or b <> v").select("o_orderkey", F.col("v").alias("level"))


@register("""
WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, i // 8 AS take, i % 8 AS place, (i % 8) * 30 AS first, (i % 8) * 30 + 29 AS last, cast(least(8, n - (i // 8) * 8) AS BIGINT) AS shots FROM s
""")
def shot_slots(spark: SparkSession, d: str) -> DataFrame:
    """Settings of each customer placed on whole shots of thirty frames, eight shots a take."""
    w = Window.partitionBy("o_custkey")
    s = table(spark, d, "orders").select("o_orderkey", (F.row_number().over(w.orderBy("o_orderkey")).cast("long") - 1).alias("i"), F.count("*").over(w).alias("n"))
    return s.select("o_orderkey", F.expr("i div 8").alias("take"), F.expr("i % 8").alias("place"), F.expr("i % 8 * 30").alias("first"), F.expr("i % 8 * 30 + 29").alias("last"), F.least(F.lit(8), F.expr("n - i div 8 * 8")).alias("shots"))


@register(_E + """,
m AS (SELECT user_id, cast(round_even((t - min(t) OVER (PARTITION BY user_id)) / 3600000000.0, 0) AS BIGINT) AS edge, event_type FROM e)
SELECT user_id, edge, lead(edge) OVER (PARTITION BY user_id ORDER BY edge) AS next FROM (SELECT DISTINCT user_id, edge FROM m WHERE event_type IN ('signup', 'purchase') OR edge = 0)
""")
def bar_edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct marks of a user (starts, cuts) on the hourly grid, as consecutive bars."""
    m = events(spark, d).withColumn("edge", F.rint((F.col("t") - F.min("t").over(Window.partitionBy("user_id"))) / F.lit(float(HOUR))).cast("long"))
    edges = m.where("event_type in ('signup', 'purchase') or edge = 0").select("user_id", "edge").distinct()
    return edges.withColumn("next", F.lead("edge").over(Window.partitionBy("user_id").orderBy("edge")))


@register("""
WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS i FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN i % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN i % 2 = 0 THEN i ELSE -i END) AS stop FROM p)
SELECT p_partkey, stop FROM k
""")
def tour_order(spark: SparkSession, d: str) -> DataFrame:
    """Walk over a brand's settings, even places up and odd places down, so that the way back is not empty."""
    by = Window.partitionBy("p_brand")
    p = table(spark, d, "part").select("p_partkey", "p_brand", (F.row_number().over(by.orderBy("p_size", "p_partkey")) - 1).alias("i"))
    odd = F.col("i") % 2
    return p.select("p_partkey", F.row_number().over(by.orderBy(odd, F.when(odd == 0, F.col("i")).otherwise(-F.col("i")))).cast("long").alias("stop"))


@register("""
WITH v AS (SELECT DISTINCT p_type, cast(round_even(p_retailprice, 0) AS BIGINT) % 1024 AS v FROM part), g AS (SELECT p_type, v & 992 AS class, list_sort(list(v)) AS members FROM v GROUP BY 1, 2)
SELECT p_type, class, len(members) AS n, members[len(members) // 2 + 1] AS representative FROM g
""")
def mask_classes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values grouped by the bits a program reads, each class with its middle value."""
    v = table(spark, d, "part").select("p_type", (F.rint("p_retailprice").cast("long") % 1024).alias("v")).distinct()
    classed = v.withColumn("class", F.col("v").bitwiseAND(F.lit(992).cast("long")))
    return classed.groupBy("p_type", "class").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("v")).alias("m")).select("p_type", "class", "n", F.get("m", F.expr("cast(n div 2 as int)")).alias("representative"))


@register("""
SELECT o_orderkey, cast(floor((2 * o_orderkey * 1001 + 30000) / (2 * 30000)) AS BIGINT) AS tick, round(1.5 + o_orderkey / 30.0, 9) AS at, cast(round_even((o_totalprice / 1000 - 1.5) * 30, 0) AS BIGINT) AS frame, cast(((cast(round_even(o_totalprice / 100, 0) AS BIGINT) % 240) + 240) % 240 AS BIGINT) AS looped, cast(ceil(o_totalprice / 1000 * 29.97) AS BIGINT) AS frames, greatest(1, cast(round_even(1023 / (2.0 * (1 + o_orderkey % 32)), 0) AS BIGINT)) AS margin FROM orders
""")
def clock_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Ticks at a rational rate (halves up), frame times, nearest frames, looped frames, frames of a duration, half sampling steps."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, d, "orders").select(
        k, F.expr("(2 * o_orderkey * 1001 + 30000) div 60000").alias("tick"), F.round(1.5 + k / 30.0, 9).alias("at"), F.rint((p / 1000 - 1.5) * 30).cast("long").alias("frame"), F.pmod(F.rint(p / 100).cast("long"), F.lit(240)).alias("looped"),
        F.ceil(p / 1000 * 29.97).cast("long").alias("frames"), F.greatest(F.lit(1), F.rint(1023 / (2.0 * (1 + k % 32))).cast("long")).alias("margin"),
    )


@register("""
WITH p AS (SELECT p_partkey, p_name, p_size, p_size * 20 AS span, p_size % 4 AS mode FROM part),
k AS (SELECT *, CASE WHEN mode = 0 THEN 'unused' WHEN span <= 40 THEN 'boolean' WHEN mode = 1 AND span < 640 THEN 'quantized' ELSE 'continuous' END AS kind FROM p)
SELECT p_partkey, kind, kind IN ('quantized', 'continuous') AS drivable, CASE kind WHEN 'boolean' THEN CASE WHEN p_size >= 2 THEN 1023 ELSE 0 END WHEN 'unused' THEN NULL ELSE cast(round_even(span * 1023 / 1000.0, 0) AS BIGINT) END AS initial,
CASE WHEN kind = 'unused' THEN 0 WHEN p_size * 8 >= 1023 - p_size * 12 THEN 0 ELSE p_size * 12 END AS safe_low, CASE WHEN kind = 'unused' THEN 0 WHEN p_size * 8 >= 1023 - p_size * 12 THEN p_size * 8 ELSE 1023 END AS safe_high FROM k
""")
def parameter_specs(spark: SparkSession, d: str) -> DataFrame:
    """Kind of a parameter by its mode and span, whether it can be driven, its initial value and the wider side of its dead zone."""
    size = F.col("p_size")
    p = table(spark, d, "part").select("p_partkey", size, (size * 20).alias("span"), (size % 4).alias("mode"))
    kind = F.when(F.col("mode") == 0, "unused").when(F.col("span") <= 40, "boolean").when((F.col("mode") == 1) & (F.col("span") < 640), "quantized").otherwise("continuous")
    k = p.withColumn("kind", kind)
    unused, below = F.col("kind") == "unused", size * 8 >= 1023 - size * 12
    initial = F.when(F.col("kind") == "boolean", F.when(size >= 2, F.lit(1023).cast("long")).otherwise(F.lit(0).cast("long"))).when(~unused, F.rint(F.col("span") * 1023 / 1000.0).cast("long"))
    return k.select("p_partkey", "kind", F.col("kind").isin("quantized", "continuous").alias("drivable"), initial.alias("initial"), F.when(unused | below, 0).otherwise(size * 12).alias("safe_low"), F.when(unused, 0).when(below, size * 8).otherwise(1023).alias("safe_high"))


_RGB = "WITH v AS (SELECT vec_id, unnest(cast(embedding AS DOUBLE[])) AS z, unnest(range(64)) AS i FROM embeddings), u AS (SELECT vec_id, i % 21 AS px, least(1, greatest(0, z + 0.5)) AS z, i // 21 AS ch FROM v WHERE i < 63), p AS (SELECT vec_id, px, max(z) FILTER (ch = 0) AS r, max(z) FILTER (ch = 1) AS g, max(z) FILTER (ch = 2) AS b FROM u GROUP BY 1, 2)"


@register(_RGB + """,
y AS (SELECT *, round_even(16 + 219 * (0.2126 * r + 0.7152 * g + 0.0722 * b), 0) AS y, round_even(128 + 224 * (b - (0.2126 * r + 0.7152 * g + 0.0722 * b)) / 1.8556, 0) AS u, round_even(128 + 224 * (r - (0.2126 * r + 0.7152 * g + 0.0722 * b)) / 1.5748, 0) AS v FROM p),
k AS (SELECT *, (y - 16) / 219 + 1.5748 * (v - 128) / 224 AS r2, (y - 16) / 219 + 1.8556 * (u - 128) / 224 AS b2 FROM y)
SELECT vec_id, round(avg(0.2126 * r + 0.7152 * g + 0.0722 * b), 6) AS luma_709, round(sqrt(avg(((u - 128) / 224) ** 2 + ((v - 128) / 224) ** 2) / 2), 6) AS chroma_rms, round(max(abs(r - r2)), 6) AS red_error, round(max(abs(b - b2)), 6) AS blue_error FROM k GROUP BY 1
""")
def yuv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pictures as 8-bit YUV by the 709 matrix and back: luma, RMS chroma and the largest errors."""
    from tessera.plans.settings import pixels

    r, g, b = F.col("r"), F.col("g"), F.col("b")
    luma = 0.2126 * r + 0.7152 * g + 0.0722 * b
    y = pixels(spark, d).select("vec_id", r, g, b, luma.alias("l"), F.rint(16 + 219 * luma).alias("y"), F.rint(128 + 224 * (b - luma) / 1.8556).alias("u"), F.rint(128 + 224 * (r - luma) / 1.5748).alias("v"))
    u, v = (F.col("u") - 128) / 224, (F.col("v") - 128) / 224
    level = (F.col("y") - 16) / 219
    return y.groupBy("vec_id").agg(r6(F.avg("l")).alias("luma_709"), r6(F.sqrt(F.avg(u * u + v * v) / 2)).alias("chroma_rms"), r6(F.max(F.abs(r - level - 1.5748 * v))).alias("red_error"), r6(F.max(F.abs(b - level - 1.8556 * u))).alias("blue_error"))


@register("""
WITH v AS (SELECT vec_id, unnest(cast(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS i FROM embeddings), c AS (SELECT vec_id, i // 4 AS cell, avg(x) AS m FROM v GROUP BY 1, 2),
s AS (SELECT vec_id, median(m) AS cut, max(m) - min(m) AS contrast FROM c GROUP BY 1), b AS (SELECT vec_id, cast(sum(CASE WHEN m > cut THEN 1 << (15 - cell) ELSE 0 END) AS BIGINT) AS gray, any_value(contrast) AS contrast FROM c JOIN s USING (vec_id) GROUP BY 1),
x1 AS (SELECT vec_id, contrast, xor(gray, gray >> 1) AS g FROM b), x2 AS (SELECT vec_id, contrast, xor(g, g >> 2) AS g FROM x1), x3 AS (SELECT vec_id, contrast, xor(g, g >> 4) AS g FROM x2), x4 AS (SELECT vec_id, contrast, xor(g, g >> 8) AS g FROM x3)
SELECT vec_id, CASE WHEN contrast < 0.15 THEN -1 ELSE g END AS code, round(contrast, 6) AS contrast FROM x4
""")
def strip_codes(spark: SparkSession, d: str) -> DataFrame:
    """Gray codes read from the cell means of each frame's strip, -1 where the contrast leaves them illegible."""
    from tessera.functions.exprs import gray_decode

    total = lambda i: F.aggregate(F.slice("x", i * 4 + 1, 4), F.lit(0.0), lambda a, z: a + z) / 4
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    c = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), total).alias("m"))
    ordered = c.withColumn("s", F.array_sort("m")).withColumn("cut", (F.get("s", F.lit(7)) + F.get("s", F.lit(8))) / 2)
    bits = F.aggregate("m", F.lit(0).cast("long"), lambda a, m: a * 2 + F.when(m > F.col("cut"), 1).otherwise(0))
    contrast = F.array_max("m") - F.array_min("m")
    code = F.when(contrast < 0.15, F.lit(-1).cast("long")).otherwise(gray_decode(bits, 16))
    return ordered.select("vec_id", code.alias("code"), r6(contrast).alias("contrast"))


@register("""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*/?(.*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g') AS stem, regexp_extract(url, '^[a-z]+://[^/]*/?(.*)$', 1) AS path FROM pages)
SELECT page_id, host, lower(replace(stem, '_', ' ')) AS match_key, CASE WHEN stem = path THEN stem ELSE stem || '-' || substring(sha256(path), 1, 8) END AS slug, list_extract(string_split(url, '/'), -1) AS plain, len(string_split(host, '.')) AS labels FROM p
""")
def text_names(spark: SparkSession, d: str) -> DataFrame:
    """Names from URLs: host, match key, safe stem with a digest where characters were replaced, last part."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*/?(.*)$", 1)
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1).alias("host"), path.alias("path"), F.regexp_replace(path, r"[^A-Za-z0-9._-]+", "_").alias("stem"))
    slug = F.when(F.col("stem") == F.col("path"), F.col("stem")).otherwise(F.concat("stem", F.lit("-"), F.substring(F.sha2("path", 256), 1, 8)))
    return p.select("page_id", "host", F.lower(F.replace("stem", F.lit("_"), F.lit(" "))).alias("match_key"), slug.alias("slug"), F.substring_index("url", "/", -1).alias("plain"), F.size(F.split("host", r"\.")).cast("long").alias("labels"))


@register("""
WITH r AS (SELECT event_id, event_type || ' at ' || event_id || ' cc=' || cast(json_extract(props, '$.k') AS INT) || ' value ' || cast(floor(value) AS BIGINT) AS line FROM events)
SELECT event_id, regexp_extract(line, '^([a-z]+)', 1) AS kind, cast(regexp_extract(line, 'cc=(\\d+)', 1) AS INT) AS cc, cast(regexp_extract(line, 'value (-?\\d+)', 1) AS BIGINT) AS value, CASE WHEN cast(regexp_extract(line, 'cc=(\\d+)', 1) AS INT) < 32 THEN 2 ELSE 1 END AS messages FROM r
""")
def parsed_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Monitor lines made of events and parsed again: kind, control, value, and the messages that a send takes."""
    k = F.get_json_object("props", "$.k").cast("int").cast("string")
    line = F.concat_ws("", "event_type", F.lit(" at "), F.col("event_id").cast("string"), F.lit(" cc="), k, F.lit(" value "), F.floor("value").cast("string"))
    cc = F.regexp_extract("line", r"cc=(\d+)", 1).cast("int")
    return table(spark, d, "events").select("event_id", line.alias("line")).select("event_id", F.regexp_extract("line", r"^([a-z]+)", 1).alias("kind"), cc.alias("cc"), F.regexp_extract("line", r"value (-?\d+)", 1).cast("long").alias("value"), F.when(cc < 32, 2).otherwise(1).alias("messages"))


@register(_E + """,
s AS (SELECT user_id, t // 21600000000 AS h, sum(value) AS v FROM e GROUP BY 1, 2), c AS (SELECT user_id, h, v - avg(v) OVER (PARTITION BY user_id) AS d, row_number() OVER (PARTITION BY user_id ORDER BY h) AS k FROM s),
n AS (SELECT user_id, count(*) AS n, sum(d * d) AS q FROM c GROUP BY 1), l AS (SELECT unnest(range(0, 14)) AS lag),
a AS (SELECT c.user_id, lag, sum(c.d * b.d) AS s FROM c CROSS JOIN l JOIN c b ON b.user_id = c.user_id AND b.k = c.k + lag GROUP BY 1, 2),
f AS (SELECT a.user_id, n, lag, s / q AS r, lag(s / q) OVER w AS p, lead(s / q) OVER w AS x FROM a JOIN n USING (user_id) WHERE q > 0 WINDOW w AS (PARTITION BY a.user_id ORDER BY lag)),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(r, 9) DESC, lag) AS k FROM f WHERE lag BETWEEN 1 AND 12 AND r > p AND r > x)
SELECT user_id, n, cast(lag AS INT) AS lag, round(r, 6) AS strength, round(lag - 0.5 * (x - p) / (p - 2 * r + x), 5) AS period, round(1 / (lag - 0.5 * (x - p) / (p - 2 * r + x)), 6) AS winding, r >= 2.865 / sqrt(n) AS significant FROM m WHERE k = 1
""")
def dominant_period(spark: SparkSession, d: str) -> DataFrame:
    """Strongest autocorrelation peak of each user's six-hour sums, refined by a parabola, against the Bonferroni bound of twelve lags."""
    from tessera.operators.series import autocorrelation

    s = events(spark, d).groupBy("user_id", F.floor(F.col("t") / (6 * HOUR)).alias("h")).agg(F.sum("value").alias("v"))
    a = autocorrelation(s, key=["user_id"], order_by=["h"], value="v", lags=list(range(0, 14)))
    w = Window.partitionBy("user_id").orderBy("lag")
    f = a.where("acf is not null").select("user_id", "n", "lag", F.col("acf").alias("r"), F.lag("acf").over(w).alias("p"), F.lead("acf").over(w).alias("x")).where("lag between 1 and 12 and r > p and r > x")
    best = f.groupBy("user_id").agg(F.min(F.struct((-F.round("r", 9)).alias("o"), "lag", "n", "r", "p", "x")).alias("b")).select("user_id", "b.*")
    period = F.col("lag") - 0.5 * (F.col("x") - F.col("p")) / (F.col("p") - 2 * F.col("r") + F.col("x"))
    return best.select("user_id", "n", F.col("lag").cast("int").alias("lag"), r6("r").alias("strength"), F.round(period, 5).alias("period"), r6(1 / period).alias("winding"), (F.col("r") >= 2.865 / F.sqrt("n")).alias("significant"))


@register(_E + """,
v AS (SELECT user_id, event_id, t, value, CASE WHEN abs(value - lag(value) OVER w) >= 10 THEN 1 ELSE 0 END AS f, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
c AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS n FROM v),
b AS (SELECT *, max(n) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) > 6 AS bad FROM c),
m AS (SELECT user_id, event_id, bad, n, CASE WHEN bad THEN avg(value) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE value END AS value FROM b)
SELECT event_id, bad AS unsafe, cast(n AS BIGINT) AS flashes, round(value, 6) AS mitigated FROM m
""")
def mitigated_flashes(spark: SparkSession, d: str) -> DataFrame:
    """Flash counts over eight events, the events that lie in a window over the limit, and a moving average in its place."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    jump = F.when(F.abs(F.col("value") - F.lag("value").over(w)) >= 10, 1).otherwise(0)
    c = events(spark, d).withColumn("f", jump).withColumn("n", F.sum("f").over(w.rowsBetween(-7, 0)))
    bad = F.max("n").over(w.rowsBetween(0, 7)) > 6
    return c.select("event_id", bad.alias("unsafe"), F.col("n").alias("flashes"), r6(F.when(bad, F.avg("value").over(w.rowsBetween(-2, 2))).otherwise(F.col("value"))).alias("mitigated"))


@register(_E + """,
f AS (SELECT user_id, t, event_id, abs(value - lag(value) OVER w) AS d, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
l AS (SELECT user_id, avg(d) + 3 * stddev_pop(d) + 1e-6 AS floor FROM f WHERE k BETWEEN 2 AND 11 GROUP BY 1), q AS (SELECT f.user_id, k, d < floor * 0.5 AS quiet, floor FROM f JOIN l USING (user_id) WHERE k >= 2),
r AS (SELECT user_id, k, min(k) OVER (PARTITION BY user_id) AS k0, bool_and(quiet) OVER (PARTITION BY user_id ORDER BY k ROWS 2 PRECEDING) AND count(*) OVER (PARTITION BY user_id ORDER BY k ROWS 2 PRECEDING) = 3 AS settled, floor FROM q)
SELECT user_id, round(any_value(floor), 6) AS floor, min(k) FILTER (settled) AS settle FROM r GROUP BY 1
""")
def settle_frames(spark: SparkSession, d: str) -> DataFrame:
    """Floor of a user's changes from the first ten, and the first event at which three in a row stay under half of it."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    f = events(spark, d).select("user_id", F.abs(F.col("value") - F.lag("value").over(w)).alias("d"), F.row_number().over(w).cast("long").alias("k")).where("k >= 2")
    floor = f.where("k <= 11").groupBy("user_id").agg((F.avg("d") + 3 * F.stddev_pop("d") + 1e-6).alias("floor"))
    last = Window.partitionBy("user_id").orderBy("k").rowsBetween(-2, 0)
    r = f.join(floor, "user_id").withColumn("quiet", F.col("d") < F.col("floor") * 0.5).select("user_id", "k", "floor", (F.every("quiet").over(last) & (F.count("*").over(last) == 3)).alias("settled"))
    return r.groupBy("user_id").agg(r6(F.first("floor")).alias("floor"), F.min(F.when(F.col("settled"), F.col("k"))).alias("settle"))


@register(_E + """,
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM e), m AS (SELECT user_id, k, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS g FROM k WHERE event_type IN ('error', 'signup'))
SELECT user_id, min(k) AS first, count(*) AS length FROM m GROUP BY user_id, g
""")
def missing_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive messages of a user that carry nothing."""
    k = events(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).cast("long")).where("event_type in ('error', 'signup')")
    return k.withColumn("g", F.col("k") - F.row_number().over(Window.partitionBy("user_id").orderBy("k"))).groupBy("user_id", "g").agg(F.min("k").alias("first"), F.count("*").alias("length")).drop("g")


@register(_E + """,
a AS (SELECT user_id, event_type, ((t // 3600000000) % 24) AS hour, lag((t // 3600000000) % 24) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM e),
s AS (SELECT user_id, (hour - before + 24) % 24 AS step FROM a WHERE before IS NOT NULL), c AS (SELECT user_id, step, count(*) AS n FROM s GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, step) AS k FROM c),
r AS (SELECT user_id, avg(CASE WHEN step = 0 THEN 1.0 ELSE 0 END) AS repeats, avg(CASE WHEN step > 12 THEN 1.0 ELSE 0 END) AS scrambled FROM s GROUP BY 1)
SELECT user_id, cast(step AS BIGINT) AS lag, round(n / total, 6) AS agreement, round(repeats, 6) AS repeats, round(scrambled, 6) AS scrambled, CASE WHEN n / total >= 0.5 THEN 'alive' WHEN repeats >= 0.2 THEN 'frozen' WHEN scrambled >= 0.5 THEN 'destroyed' ELSE 'mixed' END AS verdict FROM k JOIN r USING (user_id) WHERE k = 1
""")
def sequence_states(spark: SparkSession, d: str) -> DataFrame:
    """Circular steps between the hours of a user's events: modal step, its share, repeats, steps back, and a verdict."""
    hour = F.floor(F.col("t") / HOUR) % 24
    a = events(spark, d).select("user_id", "t", "event_id", hour.alias("hour"))
    before = F.lag("hour").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    s = a.withColumn("before", before).where("before is not null").select("user_id", F.pmod(F.col("hour") - F.col("before"), F.lit(24)).alias("step"))
    c = s.groupBy("user_id", "step").agg(F.count("*").alias("n"))
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")
    r = c.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "step", "n")).alias("b"), F.sum("n").alias("total"), share(F.col("step") == 0).alias("repeats"), share(F.col("step") > 12).alias("scrambled"))
    agree = F.col("b.n") / F.col("total")
    verdict = F.when(agree >= 0.5, "alive").when(F.col("repeats") >= 0.2, "frozen").when(F.col("scrambled") >= 0.5, "destroyed").otherwise("mixed")
    return r.select("user_id", F.col("b.step").alias("lag"), r6(agree).alias("agreement"), r6("repeats").alias("repeats"), r6("scrambled").alias("scrambled"), verdict.alias("verdict"))
