"""Profile-fit queries: robust aggregates, interactions, ranks and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import robust, series, windows
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6, table


@register("""
WITH m AS (SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, median(l_extendedprice) AS median, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY 1, 2),
d AS (SELECT l_returnflag, l_linestatus, median(abs(l_extendedprice - median)) AS mad FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, n, round(median, 4) AS median, round(CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd ELSE 1 END, 4) AS scale FROM m JOIN d USING (l_returnflag, l_linestatus)
""")
def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    """Median and MAD scale of prices by flag and status."""
    f = robust.robust_scale(table(spark, d, "lineitem"), key=["l_returnflag", "l_linestatus"], value="l_extendedprice")
    return f.select("l_returnflag", "l_linestatus", "n", F.round("median", 4).alias("median"), F.round("scale", 4).alias("scale"))


@register("""
WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) AS r FROM c)
SELECT l_suppkey, l_quantity AS mode, n AS times FROM k WHERE r = 1
""")
def mode_smallest(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent quantity of each supplier, the smallest on a tie."""
    return robust.mode_smallest(table(spark, d, "lineitem"), key=["l_suppkey"], value="l_quantity")


@register("""
WITH m AS (SELECT l_partkey, l_suppkey, avg(l_discount) AS mean FROM lineitem GROUP BY 1, 2 HAVING count(l_discount) > 1),
r AS (SELECT abs(l_discount - mean) AS r FROM lineitem JOIN m USING (l_partkey, l_suppkey))
SELECT count(*) AS rows, round(CASE WHEN count(*) >= 4 THEN greatest(0.05, 1.4826 * median(r)) ELSE 0.05 END, 6) AS noise FROM r
""")
def replicate_noise(spark: SparkSession, d: str) -> DataFrame:
    """Noise of the discount over replicated (part, supplier) settings."""
    return robust.replicate_noise(table(spark, d, "lineitem"), setting=["l_partkey", "l_suppkey"], value="l_discount").select("rows", r6("noise").alias("noise"))


@register("""
WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n, sum(l_extendedprice) AS s, sum(l_extendedprice * l_extendedprice) AS q FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_returnflag, cast(sum(n) AS BIGINT) AS rows, count(*) AS levels, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM c GROUP BY 1)
SELECT l_returnflag, rows, levels, round(1 - (q - b) / (q - s * s / rows), 6) AS r2 FROM t
""")
def pointwise_r2(spark: SparkSession, d: str) -> DataFrame:
    """Share of the price's variance that the quantity explains level by level."""
    return robust.pointwise_fit(table(spark, d, "lineitem"), key=["l_returnflag"], x="l_quantity", y="l_extendedprice").select("l_returnflag", "rows", "levels", r6("r2").alias("r2"))


@register("""
WITH x AS (SELECT p_size // 10 AS size_bin, l_discount, l_extendedprice AS y FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT size_bin, l_discount, avg(y) AS cell, count(*) AS n FROM x GROUP BY 1, 2), a AS (SELECT size_bin, avg(y) AS r FROM x GROUP BY 1), b AS (SELECT l_discount, avg(y) AS k FROM x GROUP BY 1), g AS (SELECT avg(y) AS g FROM x)
SELECT size_bin, l_discount, n, round(cell, 4) AS cell, round(cell - r - k + g, 4) AS residual FROM c JOIN a USING (size_bin) JOIN b USING (l_discount) CROSS JOIN g
""")
def additive_interaction(spark: SparkSession, d: str) -> DataFrame:
    """Cells of part size and discount against the additive model."""
    parts = table(spark, d, "part").select("p_partkey", F.floor(F.col("p_size") / 10).cast("int").alias("size_bin"))
    x = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    found = robust.additive_residual(x, a="size_bin", b="l_discount", y="l_extendedprice")
    return found.select("size_bin", "l_discount", "n", F.round("cell", 4).alias("cell"), F.round("residual", 4).alias("residual"))


@register("""
WITH x AS (SELECT l_discount, l_tax, l_extendedprice AS y FROM lineitem)
SELECT l_discount, l_tax, count(*) AS n, round(avg(y), 2) AS mean, grouping(l_discount) AS all_discounts, grouping(l_tax) AS all_taxes FROM x GROUP BY GROUPING SETS ((l_discount, l_tax), (l_discount), (l_tax), ())
""")
def interaction_margins(spark: SparkSession, d: str) -> DataFrame:
    """Cell, row, column and grand means in one pass."""
    cube = table(spark, d, "lineitem").cube("l_discount", "l_tax")
    return cube.agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 2).alias("mean"), F.grouping("l_discount").cast("long").alias("all_discounts"), F.grouping("l_tax").cast("long").alias("all_taxes"))


@register("""
WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, rank() OVER w + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice))
SELECT o_orderkey, round(CASE WHEN n > 1 THEN r / (n - 1) ELSE 0.5 END, 6) AS midrank FROM a
""")
def midrank(spark: SparkSession, d: str) -> DataFrame:
    """Mid-rank of the order's price within its priority."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return windows.midrank(o, key=["o_orderpriority"], value="o_totalprice").select("o_orderkey", r6("midrank").alias("midrank"))


@register("""
WITH m AS (SELECT o_orderkey, o_totalprice, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT *, (rank() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice) - 1 + (count(*) OVER (PARTITION BY c_mktsegment, o_totalprice) - 1) / 2.0) / (count(*) OVER (PARTITION BY c_mktsegment) - 1) AS a,
(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0) / (count(*) OVER (PARTITION BY c_mktsegment) - 1) AS b FROM m)
SELECT o_orderkey, round(0.7 * a + 0.3 * b, 6) AS drive FROM r
""")
def drive_blend(spark: SparkSession, d: str) -> DataFrame:
    """Blend of two mid-ranks within a segment."""
    m = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_acctbal", "c_mktsegment")
    a = windows.midrank(m, key=["c_mktsegment"], value="o_totalprice").withColumnRenamed("midrank", "a")
    b = windows.midrank(a, key=["c_mktsegment"], value="c_acctbal").withColumnRenamed("midrank", "b")
    return b.select("o_orderkey", r6(0.7 * F.col("a") + 0.3 * F.col("b")).alias("drive"))


@register("""
WITH v AS (SELECT DISTINCT p_size FROM part), b AS (SELECT p_size, cast(floor((dense_rank() OVER (ORDER BY p_size) - 1) * 4 / (SELECT count(*) FROM v)) AS INT) AS bin FROM v)
SELECT bin, count(*) AS n, min(p_size) AS low, max(p_size) AS high, round(avg(p_retailprice), 4) AS mean FROM part JOIN b USING (p_size) GROUP BY 1
""")
def rank_bins(spark: SparkSession, d: str) -> DataFrame:
    """Part sizes in four rank bins."""
    b = windows.rank_bins(table(spark, d, "part"), value="p_size", bins=4)
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.min("p_size").alias("low"), F.max("p_size").alias("high"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


@register("""
WITH a AS (SELECT l_linenumber, rank() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linenumber, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT l_linenumber, count(*) AS n, round(corr(x, y), 6) AS rho FROM a GROUP BY 1
""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of quantity and price."""
    x = table(spark, d, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice")
    return robust.spearman(x, key=["l_linenumber"], x="l_quantity", y="l_extendedprice").select("l_linenumber", "n", r6("rho").alias("rho"))


@register("SELECT o_orderstatus, count(*) AS n, round(regr_slope(o_totalprice, o_orderkey), 9) AS slope, round(regr_intercept(o_totalprice, o_orderkey), 3) AS intercept, round(corr(o_totalprice, o_orderkey), 6) AS r FROM orders GROUP BY 1")
def line_fit(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares line of price on order key."""
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.regr_slope("o_totalprice", "o_orderkey"), 9).alias("slope"), F.round(F.regr_intercept("o_totalprice", "o_orderkey"), 3).alias("intercept"), r6(F.corr("o_totalprice", "o_orderkey")).alias("r"))


@register("SELECT l_returnflag, count(*) AS n, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_discount) AS min_l_discount, max(l_discount) AS max_l_discount FROM lineitem GROUP BY 1")
def stability_regions(spark: SparkSession, d: str) -> DataFrame:
    """Range of every setting under each label."""
    return robust.stability_regions(table(spark, d, "lineitem"), label="l_returnflag", params=["l_quantity", "l_discount"])


@register("""
WITH g AS (SELECT l_quantity, avg(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END) AS u, avg(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END) AS v FROM lineitem GROUP BY 1)
SELECT l_quantity, round(u, 4) AS up_mean, round(v, 4) AS down_mean, round(u - v, 4) AS gap FROM g WHERE u IS NOT NULL AND v IS NOT NULL
""")
def hysteresis(spark: SparkSession, d: str) -> DataFrame:
    """Up pass against down pass at each setpoint."""
    x = table(spark, d, "lineitem").withColumn("up", F.col("l_linenumber") % 2 == 1)
    h = robust.hysteresis(x, at="l_quantity", up="up", value="l_extendedprice")
    return h.select("l_quantity", *[F.round(c, 4).alias(c) for c in ("up_mean", "down_mean", "gap")])


@register("""
WITH v AS (SELECT l_discount AS x, count(*) AS n, sum(l_extendedprice) AS s, sum(l_extendedprice * l_extendedprice) AS q FROM lineitem GROUP BY 1), w AS (SELECT unnest([0.0, 0.01, 0.02, 0.04, 0.08]) AS width),
f AS (SELECT width, a.x, a.n, a.s, a.q, sum(k * b.s) AS u, sum(k * b.n) AS v FROM (SELECT *, CASE WHEN width > 0 THEN exp(-(x - x2) * (x - x2) / (2 * width * width)) WHEN x = x2 THEN 1 ELSE 0 END AS k FROM w, v, (SELECT x AS x2 FROM v)) a JOIN v b ON a.x2 = b.x GROUP BY ALL),
e AS (SELECT width, sum(q - 2 * s * l + n * l * l) AS e FROM (SELECT *, (u - s / n) / (v - 1) AS l FROM f WHERE v > 1) GROUP BY 1), z AS (SELECT width FROM e ORDER BY e, width LIMIT 1)
SELECT x, n, cast(width AS DOUBLE) AS width, round(u / v, 4) AS curve FROM f JOIN z USING (width)
""")
def kernel_curve(spark: SparkSession, d: str) -> DataFrame:
    """Price over discount by kernel means, the width chosen by leave-one-out error."""
    return robust.kernel_curve(table(spark, d, "lineitem"), x="l_discount", y="l_extendedprice", widths=[0.0, 0.01, 0.02, 0.04, 0.08]).select("x", "n", "width", F.round("curve", 4).alias("curve"))


@register("""
WITH m AS (SELECT *, o_orderkey % 4 AS fold FROM orders), o AS (SELECT o_orderpriority, fold, count(*) AS n, sum(o_totalprice) AS s FROM m GROUP BY 1, 2), t AS (SELECT o_orderpriority, sum(n) AS tn, sum(s) AS ts FROM o GROUP BY 1),
h AS (SELECT o_orderpriority, fold, (ts - s) / (tn - n) AS g FROM o JOIN t USING (o_orderpriority) WHERE tn > n)
SELECT fold, count(*) AS n, round(sqrt(avg((o_totalprice - g) ** 2)), 3) AS rms, round(median(abs(o_totalprice - g)), 3) AS median_abs FROM m JOIN h USING (o_orderpriority, fold) GROUP BY 1
""")
def kfold_eval(spark: SparkSession, d: str) -> DataFrame:
    """Held-out error of group means over four folds."""
    k = robust.kfold_error(table(spark, d, "orders"), fold=F.col("o_orderkey") % 4, folds=4, group=["o_orderpriority"], value="o_totalprice")
    return k.select("fold", "n", F.round("rms", 3).alias("rms"), F.round("median_abs", 3).alias("median_abs"))


@register("""
WITH z AS (SELECT value FROM events WHERE event_type = 'view'), a AS (SELECT event_id, value FROM events WHERE event_type = 'error'),
v AS (SELECT value, count(*) AS n FROM z GROUP BY 1), t AS (SELECT sum(n) AS n FROM v)
SELECT a.event_id, round((coalesce((SELECT sum(n) FROM v WHERE v.value > a.value), 0) + coalesce((SELECT sum(n) FROM v WHERE v.value = a.value), 0) / 2.0) / (SELECT n FROM t), 6) AS p FROM a
""")
def tail_midp(spark: SparkSession, d: str) -> DataFrame:
    """Mid-p of error values in the empirical null of view values."""
    found = series.tail_midp(events(spark, d, "error").select("event_id", "value"), events(spark, d, "view").select("value"), value="value")
    return found.select("event_id", r6("p").alias("p"))
