"""Scalar, string, bit, set and design queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.operators import design
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6, table

_RGB = "WITH v AS (SELECT vec_id, unnest(cast(embedding AS DOUBLE[])) AS z, unnest(range(64)) AS i FROM embeddings), u AS (SELECT vec_id, i % 21 AS px, least(1, greatest(0, z + 0.5)) AS z, i // 21 AS ch FROM v WHERE i < 63), p AS (SELECT vec_id, px, max(z) FILTER (ch = 0) AS r, max(z) FILTER (ch = 1) AS g, max(z) FILTER (ch = 2) AS b FROM u GROUP BY 1, 2)"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 21-pixel pictures: thirds of the first 63 values are red, green and blue, moved into [0, 1]."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c.cast("double") + 0.5))
    e = table(spark, d, "embeddings").select("vec_id", F.explode(F.arrays_zip(*[F.slice("embedding", 21 * k + 1, 21).alias(n) for k, n in enumerate("rgb")])).alias("p"))
    return e.select("vec_id", *[unit(F.col(f"p.{n}")).alias(n) for n in "rgb"])


@register(_RGB + """,
l AS (SELECT vec_id, r * 0.299 + g * 0.587 + b * 0.114 AS y, r, g, b FROM p), c AS (SELECT *, sqrt(((b - y) * 0.492) ** 2 + ((r - y) * 0.877) ** 2) AS c FROM l)
SELECT vec_id, round(avg(y), 6) AS luma_mean, round(stddev_pop(y), 6) AS luma_std, round(avg(c), 6) AS chroma_mean, round(stddev_pop(c), 6) AS chroma_std, round(avg(CASE WHEN greatest(r, g, b) >= 1 OR least(r, g, b) <= 0 THEN 1.0 ELSE 0.0 END), 6) AS clip FROM c GROUP BY 1
""")
def level_stats(spark: SparkSession, d: str) -> DataFrame:
    """Luma, chroma and clipping of each picture."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    p = pixels(spark, d).select("*", x.luma(r, g, b).alias("y"), x.chroma(r, g, b).alias("c"))
    clip = F.when((F.greatest(r, g, b) >= 1) | (F.least(r, g, b) <= 0), 1.0).otherwise(0.0)
    return p.groupBy("vec_id").agg(r6(F.avg("y")).alias("luma_mean"), r6(F.stddev_pop("y")).alias("luma_std"), r6(F.avg("c")).alias("chroma_mean"), r6(F.stddev_pop("c")).alias("chroma_std"), r6(F.avg(clip)).alias("clip"))


@register(_RGB + """,
n AS (SELECT vec_id, CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE ((r + 0.055) / 1.055) ** 2.4 END AS r, CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE ((g + 0.055) / 1.055) ** 2.4 END AS g, CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE ((b + 0.055) / 1.055) ** 2.4 END AS b FROM p)
SELECT vec_id, round(avg(0.2126 * r + 0.7152 * g + 0.0722 * b), 6) AS luminance, count(*) FILTER (r + g + b > 0 AND r >= 0.5 * (r + g + b)) AS reddish, round(max(320 * greatest(0, r - g - b)), 5) AS red FROM n GROUP BY 1
""")
def luminance_red(spark: SparkSession, d: str) -> DataFrame:
    """Relative luminance and red quantities of each picture."""
    p = pixels(spark, d).select("vec_id", *[x.linear_rgb(F.col(c)).alias(c) for c in "rgb"])
    total = F.col("r") + F.col("g") + F.col("b")
    return p.groupBy("vec_id").agg(r6(F.avg(x.weighted(F.col("r"), F.col("g"), F.col("b"), x.REC709))).alias("luminance"), F.count_if((total > 0) & (F.col("r") >= 0.5 * total)).alias("reddish"), F.round(F.max(320 * F.greatest(F.lit(0.0), F.col("r") - F.col("g") - F.col("b"))), 5).alias("red"))


@register(_RGB + ", o AS (SELECT vec_id, r - g AS a, (r + g) / 2 - b AS c FROM p) SELECT vec_id, round(sqrt(var_pop(a) + var_pop(c)) + 0.3 * sqrt(avg(a) ** 2 + avg(c) ** 2), 6) AS colourfulness FROM o GROUP BY 1")
def colourfulness(spark: SparkSession, d: str) -> DataFrame:
    """Spread and mean of the opponent colours."""
    a, c = F.col("r") - F.col("g"), (F.col("r") + F.col("g")) / 2 - F.col("b")
    return pixels(spark, d).groupBy("vec_id").agg(r6(F.sqrt(F.var_pop(a) + F.var_pop(c)) + 0.3 * F.sqrt(F.avg(a) ** 2 + F.avg(c) ** 2)).alias("colourfulness"))


@register("""
SELECT o_orderkey, round(CASE WHEN o_totalprice > 0 THEN o_totalprice / (1 + o_totalprice) ELSE 0 END, 9) AS saturated, round(greatest(100000 - o_totalprice, o_totalprice - 200000, 0), 4) AS outside,
cast(round_even(least(greatest(o_totalprice / 500000, 0), 1) * 1023, 0) AS INT) AS device, CASE WHEN round_even(least(greatest(o_totalprice / 500000, 0), 1) * 1023, 0) >= 512 THEN 1023 ELSE 0 END AS toggle,
CASE WHEN o_totalprice <= 100000 THEN 'analog' WHEN o_totalprice >= 200000 THEN 'digital' ELSE 'mixed' END AS style FROM orders
""")
def scalar_maps(spark: SparkSession, d: str) -> DataFrame:
    """Saturation, band distance, device units, toggles and a three-way class of order prices."""
    p = F.col("o_totalprice")
    unit = x.to_device(p / 500000)
    return table(spark, d, "orders").select("o_orderkey", F.round(x.saturate(p), 9).alias("saturated"), F.round(x.band_distance(p, 100000.0, 200000.0), 4).alias("outside"), unit.alias("device"), x.snap_toggle(unit).alias("toggle"), x.three_way(p, 100000.0, 200000.0, ("analog", "mixed", "digital")).alias("style"))


@register("""
WITH b AS (SELECT l_orderkey, l_linenumber, xor(l_partkey, l_partkey >> 1) AS gray, (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END) | (CASE l_linestatus WHEN 'O' THEN 8 ELSE 0 END) AS code FROM lineitem)
SELECT l_orderkey, cast(bit_or(code) AS INT) AS regime, bit_xor(gray) AS gray, bit_or(1 << (l_linenumber - 1)) AS lines FROM b GROUP BY 1
""")
def bit_codes(spark: SparkSession, d: str) -> DataFrame:
    """Flags packed into a regime code, Gray codes and register bits of an order."""
    code = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(4).bitwiseOR(F.when(F.col("l_linestatus") == "O", 8).otherwise(0))
    rows = table(spark, d, "lineitem").select("l_orderkey", code.alias("code"), x.gray_encode(F.col("l_partkey")).alias("gray"), F.expr("shiftleft(1, l_linenumber - 1)").alias("bit"))
    return rows.groupBy("l_orderkey").agg(F.bit_or("code").alias("regime"), F.bit_xor("gray").alias("gray"), F.bit_or("bit").alias("lines"))


@register("SELECT l_partkey, l_partkey AS decoded, CASE WHEN l_partkey % 1024 >= 512 THEN l_partkey % 1024 - 1024 ELSE l_partkey % 1024 END AS signed FROM lineitem")
def gray_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Gray codes decoded again, and codes with a sign."""
    k = F.col("l_partkey")
    return table(spark, d, "lineitem").select(k, x.gray_decode(x.gray_encode(k), 32).alias("decoded"), x.signed(k % 1024, 10).alias("signed"))


@register("SELECT doc_id, substring(sha256(coalesce(lang, '') || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, '')), 1, 16) AS key FROM documents")
def content_key(spark: SparkSession, d: str) -> DataFrame:
    """Content keys of documents."""
    return table(spark, d, "documents").select("doc_id", x.content_key(*[F.coalesce(c, F.lit("")) for c in ("lang", "source", "text")]).alias("key"))


@register("""
WITH c AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[ \n](the|and|of)[ \n]')) AS a, len(regexp_extract_all(lower(text), '[ \n](der|die|und)[ \n]')) AS b FROM documents)
SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN 'UNKNOWN' WHEN a > b THEN 'ENGLISH' WHEN b > a THEN 'GERMAN' ELSE 'MIXED' END AS label FROM c
""")
def style_label(spark: SparkSession, d: str) -> DataFrame:
    """Style of a text by which of two patterns matches more often."""
    return table(spark, d, "documents").select("doc_id", x.style_label(F.col("text"), r"[ \n](the|and|of)[ \n]", r"[ \n](der|die|und)[ \n]", ("ENGLISH", "GERMAN")).alias("label"))


@register("SELECT event_type, cast(json_extract(props, '$.k') AS INT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def payload_counts(spark: SparkSession, d: str) -> DataFrame:
    """Slots read from a JSON payload."""
    k = F.get_json_object("props", "$.k").cast("int") % 10
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@register("""
WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT 'both' AS side, k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'customers', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT 'suppliers', k FROM (SELECT k FROM s EXCEPT SELECT k FROM c)
""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Nations with customers, suppliers or both, from one pass a side."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("s"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(2).alias("s"))
    sides = c.unionByName(s).groupBy("k").agg(F.bit_or("s").alias("s"))
    return sides.select(F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "customers").otherwise("suppliers").alias("side"), "k")


@register("""
WITH s AS (SELECT o_custkey, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + 7776000000000 AS b FROM orders)
SELECT o_custkey, count(*) AS n, cast(sum(least(b, 883612800000000) - greatest(a, 852076800000000)) AS BIGINT) AS inside FROM s WHERE b > 852076800000000 AND a < 883612800000000 GROUP BY 1
""")
def interval_clip(spark: SparkSession, d: str) -> DataFrame:
    """Ninety-day spans of orders clipped to 1997."""
    low, high = 852_076_800_000_000, 883_612_800_000_000
    a = x.micros(F.col("o_orderdate"))
    s = table(spark, d, "orders").select("o_custkey", a.alias("a"), (a + 7_776_000_000_000).alias("b")).where((F.col("b") > low) & (F.col("a") < high))
    return s.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.least("b", F.lit(high)) - F.greatest("a", F.lit(low))).alias("inside"))


@register("WITH k AS (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) SELECT c_mktsegment, c_custkey, k FROM k WHERE k <= 10")
def top_targets(spark: SparkSession, d: str) -> DataFrame:
    """Ten strongest candidates of each axis."""
    k = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, d, "customer").withColumn("k", k).where("k <= 10").select("c_mktsegment", "c_custkey", F.col("k").cast("long").alias("k"))


@register("""
WITH l AS (SELECT DISTINCT l_discount AS level, 'l_discount' AS param FROM lineitem UNION SELECT DISTINCT l_tax, 'l_tax' FROM lineitem), b AS (SELECT 'l_discount' AS param, median(l_discount) AS parked FROM lineitem UNION ALL SELECT 'l_tax', median(l_tax) FROM lineitem)
SELECT l.param AS varied, l.level, b.param, round(CASE WHEN b.param = l.param THEN l.level ELSE b.parked END, 6) AS setting FROM l CROSS JOIN b
""")
def oat_design(spark: SparkSession, d: str) -> DataFrame:
    """One-at-a-time sweep over the levels that two settings take, the other parked at its median."""
    li = table(spark, d, "lineitem").select(F.explode(F.array(*[F.struct(F.lit(c).alias("param"), F.col(c).alias("value")) for c in ("l_discount", "l_tax")])).alias("s")).select("s.*")
    runs = design.one_at_a_time(li.distinct(), li.groupBy("param").agg(F.median("value").alias("parked")), param="param", value="value")
    return runs.select("varied", "level", "param", r6("setting").alias("setting"))


@register("""
WITH s AS (SELECT nation.n_name AS name, count(*) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), e AS (SELECT name, 64 * w / sum(w) OVER () AS x FROM s), b AS (SELECT name, floor(x) AS f, round(x - floor(x), 9) AS r FROM e), k AS (SELECT *, row_number() OVER (ORDER BY r DESC, name) AS k, 64 - sum(f) OVER () AS l FROM b)
SELECT name, cast(f + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS share FROM k
""")
def apportion(spark: SparkSession, d: str) -> DataFrame:
    """64 takes shared among nations by their customers."""
    w = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("w"))
    return design.apportion(w, key="name", weight="w", total=64)


@register("""
WITH p AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_brand FROM part)
SELECT p_partkey, i // 10 AS r, CASE WHEN (i // 10) % 2 = 0 THEN i % 10 ELSE 9 - i % 10 END AS c FROM p
""")
def raster_walk(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a brand laid on a raster whose odd rows run backward."""
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long") - 1
    p = table(spark, d, "part").select("p_partkey", i.alias("i"))
    r = F.floor(F.col("i") / 10)
    return p.select("p_partkey", r.alias("r"), F.when(r % 2 == 0, F.col("i") % 10).otherwise(9 - F.col("i") % 10).alias("c"))


def _sobol_sql(dim: int, bits: int = 30) -> str:
    terms = [f"((g >> {k}) & 1) * {v}" for k, v in enumerate(design.direction_numbers(dim, bits))]
    whole = terms[0]
    for term in terms[1:]:
        whole = f"xor({whole}, {term})"
    return f"({whole}) / {float(1 << bits)!r} AS s{dim}"


@register(f"WITH g AS (SELECT p_partkey, xor(p_partkey, p_partkey >> 1) AS g FROM part) SELECT p_partkey, {', '.join(_sobol_sql(k) for k in range(3))} FROM g")
def sobol_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Unscrambled Sobol settings in three dimensions for every part."""
    return table(spark, d, "part").select("p_partkey", *[design.sobol_value(F.col("p_partkey"), k).alias(f"s{k}") for k in range(3)])


@register("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
w AS (SELECT 0 AS depth, 1 AS s UNION SELECT w.depth + 1, b.s FROM w JOIN e a ON a.s = w.s JOIN e b ON b.p = a.p WHERE w.depth < 3)
SELECT cast(s AS BIGINT) AS s, cast(min(depth) AS INT) AS depth FROM w GROUP BY 1
""")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers reached from supplier 1 over shared parts within three steps, each frontier new nodes only."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    seen = spark.range(1).select(F.lit(1).cast("long").alias("s"), F.lit(0).alias("depth"))
    front = seen
    for step in range(1, 4):
        parts = e.join(front.select("s"), "s").select("p").distinct()
        front = e.join(parts, "p").select("s").distinct().join(seen.select("s"), "s", "left_anti").withColumn("depth", F.lit(step))
        seen = seen.unionByName(front)
    return seen


@register("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 6) AS error, round(avg(value) / (stddev_samp(value) / sqrt(count(*))), 4) AS z FROM events GROUP BY 1")
def standard_errors(spark: SparkSession, d: str) -> DataFrame:
    """Mean over standard error of each type."""
    error = F.stddev_samp("value") / F.sqrt(F.count("*"))
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(error).alias("error"), F.round(F.avg("value") / error, 4).alias("z"))
