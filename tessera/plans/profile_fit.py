"""The profile fit assembled: lines as measurements, their standardised metrics, parameter fits, axes and interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fit, profiles
from tessera.plans.catalogue import oracle, register
from tessera.plans.tables import r6, table
from tessera.session import kept, shared_path

METRICS = ["price", "unit", "tax_paid", "tax_rest", "flat"]
SIGNATURES = {"level": {"price": 1.0, "unit": 0.4}, "levy": {"tax_*": 1.0}, "spread": {"unit": 1.0, "tax_paid": 0.3}}

_ROWS = """
WITH r AS (SELECT l_returnflag AS program, cast(l_quantity AS BIGINT) AS p1, cast(round(l_discount * 100) AS BIGINT) AS p2, cast(round(l_tax * 100) AS BIGINT) AS p3, l_extendedprice AS price, l_extendedprice / l_quantity AS unit, CASE WHEN l_tax > 0 THEN l_extendedprice * l_tax END AS tax_paid, CASE WHEN l_discount > 0 THEN l_extendedprice * (1 - l_tax) END AS tax_rest, l_orderkey, l_linenumber FROM lineitem),
l AS (SELECT program, p1, p2, p3, l_orderkey, l_linenumber, unnest(['price', 'unit', 'tax_paid', 'tax_rest', 'flat']) AS metric, unnest([price, unit, tax_paid, tax_rest, 1.0]) AS value FROM r),
s AS (SELECT program, metric, median(value) AS m FROM l GROUP BY 1, 2 HAVING max(value) > min(value)),
f AS (SELECT l.program, p1, p2, p3, l_orderkey, l_linenumber, l.metric, coalesce(value, m) AS value, m FROM l JOIN s USING (program, metric)),
d AS (SELECT program, metric, median(abs(value - m)) AS mad, stddev_pop(value) AS sd, max(value) - min(value) AS reach FROM f GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd ELSE 1 END AS scale FROM d),
z AS (SELECT program, p1, p2, p3, l_orderkey, l_linenumber, metric, (value - m) / scale AS z, reach / scale AS span FROM f JOIN k USING (program, metric))"""
_CURVES = _ROWS + """,
v AS (SELECT program, metric, z, span, unnest(['p1', 'p2', 'p3']) AS param, unnest([p1, p2, p3]) AS level FROM z),
c AS (SELECT program, param, level, metric, count(*) AS n, avg(z) AS curve, any_value(span) AS span FROM v GROUP BY 1, 2, 3, 4),
e AS (SELECT program, param, metric, (max(curve) - min(curve)) / 0.05 AS sensitivity, (max(curve) - min(curve)) / any_value(span) AS effect FROM c GROUP BY 1, 2, 3)"""


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """Lines as measurement rows: three settings, four metrics of which some are absent, and a constant one."""
    li, price = table(spark, d, "lineitem"), F.col("l_extendedprice")
    return li.select(
        F.col("l_returnflag").alias("program"), F.col("l_quantity").cast("long").alias("p1"), *[F.round(F.col(c) * 100).cast("long").alias(p) for p, c in (("p2", "l_discount"), ("p3", "l_tax"))],
        price.alias("price"), (price / F.col("l_quantity")).alias("unit"), F.when(F.col("l_tax") > 0, price * F.col("l_tax")).alias("tax_paid"), F.when(F.col("l_discount") > 0, price * (1 - F.col("l_tax"))).alias("tax_rest"), F.lit(1.0).alias("flat"), "l_orderkey", "l_linenumber",
    )


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    long = fit.long_metrics(measurements(spark, d), keep=["program", "p1", "p2", "p3", "l_orderkey", "l_linenumber"], metrics=METRICS)
    return fit.metric_matrix(long, key=["program"])


def _curves(spark: SparkSession, d: str) -> DataFrame:
    return kept(fit.level_curves(_matrix(spark, d), key=["program"], params=["p1", "p2", "p3"]))  # a few numbers a level


@register(_ROWS + " SELECT l_orderkey, l_linenumber, metric, round(z, 6) AS z, round(span, 4) AS span FROM z")
def metric_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Standardised metrics of every line, absent ones at the median, constant ones left out."""
    return _matrix(spark, d).select("l_orderkey", "l_linenumber", "metric", r6("z").alias("z"), F.round("span", 4).alias("span"))


@register(_CURVES + """,
g AS (SELECT program, param, arg_min(metric, (-round(sensitivity, 9), metric)) AS driver, max(round(sensitivity, 9)) AS sensitivity FROM e GROUP BY 1, 2),
m AS (SELECT *, abs(curve - lag(curve) OVER w) AS move, lag(level) OVER w AS before FROM c WINDOW w AS (PARTITION BY program, param, metric ORDER BY level)),
o AS (SELECT m.program, m.param, level, curve FROM m JOIN g ON m.program = g.program AND m.param = g.param AND m.metric = g.driver WHERE move IS NULL OR move > 0.05),
a AS (SELECT program, param, row_number() OVER (PARTITION BY program, param ORDER BY level) AS a, rank() OVER (PARTITION BY program, param ORDER BY curve) + (count(*) OVER (PARTITION BY program, param, curve) - 1) / 2.0 AS b FROM o),
h AS (SELECT program, param, CASE WHEN count(*) > 2 THEN corr(a, b) ELSE 1 END AS rho FROM a GROUP BY 1, 2),
q AS (SELECT program, param, metric, quantile_cont(move, 0.25) AS q1, quantile_cont(move, 0.75) AS q3 FROM m WHERE move IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT program, param, level, before, bool_or(move > q3 + 1.5 * (q3 - q1) + 0.05) AS cliff, bool_and(move <= 0.05) AS flat FROM m JOIN q USING (program, param, metric) WHERE move IS NOT NULL GROUP BY 1, 2, 3, 4),
i AS (SELECT *, row_number() OVER (PARTITION BY program, param ORDER BY level) - row_number() OVER (PARTITION BY program, param, flat ORDER BY level) AS g FROM t),
u AS (SELECT program, param, g, count(*) AS k, min(before) AS a, max(level) AS b FROM i WHERE flat GROUP BY 1, 2, 3 HAVING count(*) >= 2),
x AS (SELECT program, param, arg_min(a, (-k, a)) AS dead_from, arg_min(b, (-k, a)) AS dead_to FROM u GROUP BY 1, 2),
n AS (SELECT program, param, count(DISTINCT level) AS levels, min(level) AS lo, max(level) AS hi FROM c GROUP BY 1, 2),
y AS (SELECT program, param, count(*) FILTER (cliff) AS cliffs FROM t GROUP BY 1, 2)
SELECT program, param, levels, CASE WHEN levels <= 1 THEN 'unused' WHEN levels = 2 AND lo = 0 AND hi = 1023 THEN 'boolean' WHEN levels - CASE WHEN levels > 2 THEN 1 ELSE 0 END <= 16 THEN 'quantized' ELSE 'continuous' END AS kind, driver, round(sensitivity, 4) AS sensitivity, round(rho, 6) AS rho, coalesce(round(abs(rho), 9) >= 0.9, false) AS monotonic, coalesce(cliffs, 0) AS cliffs, dead_from, dead_to
FROM n JOIN g USING (program, param) LEFT JOIN h USING (program, param) LEFT JOIN y USING (program, param) LEFT JOIN x USING (program, param)
""")
def fit_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Every parameter of every program: kind, driver, sensitivity, monotonicity, dead zone and cliffs."""
    f = fit.parameter_fits(_curves(spark, d), key=["program"])
    return f.withColumn("sensitivity", F.round("sensitivity", 4)).withColumn("rho", r6("rho"))


@register(_CURVES + """,
k2 AS (SELECT unnest(['level', 'level', 'levy', 'spread', 'spread']) AS axis, unnest(['price', 'unit', 'tax_', 'unit', 'tax_paid']) AS name, unnest([false, false, true, false, false]) AS wild, unnest([1.0, 0.4, 1.0, 1.0, 0.3]) AS w),
j AS (SELECT e.*, axis, name, w / sqrt(count(*) OVER (PARTITION BY program, param, axis, name)) AS w FROM e JOIN k2 ON metric = name OR (wild AND starts_with(metric, name))),
b AS (SELECT program, param, axis, metric, max(w) AS w, any_value(effect) AS effect FROM j GROUP BY 1, 2, 3, 4),
n AS (SELECT program, param, sqrt(sum(effect * effect)) AS n FROM e GROUP BY 1, 2),
o AS (SELECT program, param, axis, round(sum(w * effect) / sqrt(sum(w * w)) / any_value(n), 9) AS c FROM b JOIN n USING (program, param) WHERE n > 0 GROUP BY 1, 2, 3),
y AS (SELECT *, row_number() OVER (PARTITION BY program, param ORDER BY c DESC, axis) AS k FROM o)
SELECT program, param, CASE WHEN c >= 0.3 THEN axis ELSE 'UNASSIGNED' END AS axis, round(c, 6) AS similarity FROM y WHERE k = 1
""")
def assigned_axes(spark: SparkSession, d: str) -> DataFrame:
    """The axis whose signature each parameter's effects resemble most."""
    a = fit.assigned_axes(fit.effects(_curves(spark, d), key=["program"]), key=["program"], signatures=SIGNATURES)
    return a.withColumn("similarity", r6("similarity"))


@register("""
WITH r AS (SELECT l_returnflag AS program, l_quantity AS p1, l_discount AS p2, l_tax AS p3, l_extendedprice AS y FROM lineitem),
b AS (SELECT *, dense_rank() OVER (PARTITION BY program ORDER BY p1) - 1 AS r1, dense_rank() OVER (PARTITION BY program ORDER BY p2) - 1 AS r2, dense_rank() OVER (PARTITION BY program ORDER BY p3) - 1 AS r3 FROM r),
m AS (SELECT program, max(r1) + 1 AS n1, max(r2) + 1 AS n2, max(r3) + 1 AS n3 FROM b GROUP BY 1), q AS (SELECT program, y, least(3, r1 * 4 // n1) AS b1, least(3, r2 * 4 // n2) AS b2, least(3, r3 * 4 // n3) AS b3 FROM b JOIN m USING (program)),
u AS (SELECT program, y, unnest(['p1', 'p1', 'p2']) AS a, unnest(['p2', 'p3', 'p3']) AS b, unnest([b1, b1, b2]) AS i, unnest([b2, b3, b3]) AS j FROM q),
c AS (SELECT program, a, b, i, j, avg(y) AS m, min(y) AS lo, max(y) AS hi FROM u GROUP BY 1, 2, 3, 4, 5),
e AS (SELECT program, a, b, lo, hi, m - avg(m) OVER (PARTITION BY program, a, b, i) - avg(m) OVER (PARTITION BY program, a, b, j) + avg(m) OVER (PARTITION BY program, a, b) AS r FROM c)
SELECT program, a, b, count(*) AS cells, round(CASE WHEN count(*) >= 12 THEN sqrt(avg(r * r)) / CASE WHEN max(hi) > min(lo) THEN max(hi) - min(lo) ELSE 1 END ELSE 0 END, 7) AS strength FROM e GROUP BY 1, 2, 3
""")
def pair_strengths(spark: SparkSession, d: str) -> DataFrame:
    """Non-additivity of every pair of settings over rank bins, each filled cell counting once."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("program"), F.col("l_quantity").alias("p1"), F.col("l_discount").alias("p2"), F.col("l_tax").alias("p3"), F.col("l_extendedprice").alias("y"))
    return fit.pair_strengths(rows, key=["program"], params=["p1", "p2", "p3"], y="y").withColumn("strength", F.round("strength", 7))


@register("""
WITH l AS (SELECT l_tax, cast(l_quantity AS BIGINT) AS lv, round(avg(l_discount) * 10, 9) AS w, avg(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, list_min([{d: round(abs(w - round_even(w * 1, 0) / 1), 12), q: 1, p: cast(round_even(w * 1, 0) AS INT)}, {d: round(abs(w - round_even(w * 2, 0) / 2), 12), q: 2, p: cast(round_even(w * 2, 0) AS INT)}, {d: round(abs(w - round_even(w * 3, 0) / 3), 12), q: 3, p: cast(round_even(w * 3, 0) AS INT)}, {d: round(abs(w - round_even(w * 4, 0) / 4), 12), q: 4, p: cast(round_even(w * 4, 0) AS INT)}]) AS f FROM l),
k AS (SELECT *, CASE WHEN f.d <= 0.0125 THEN f.p || '/' || f.q END AS lock FROM f),
g AS (SELECT *, row_number() OVER (PARTITION BY l_tax ORDER BY lv) - row_number() OVER (PARTITION BY l_tax, lock ORDER BY lv) AS g FROM k)
SELECT l_tax, any_value(f.p) AS p, any_value(f.q) AS q, (min(lv) + max(lv)) / 2 AS centre, max(lv) - min(lv) AS width, round(avg(s), 3) AS mean, count(*) AS levels FROM g WHERE lock IS NOT NULL GROUP BY l_tax, lock, g HAVING count(*) >= 2
""")
def lock_tongues(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of quantity over which the mean discount stays locked at a simple ratio, for each tax."""
    line = table(spark, d, "lineitem").groupBy("l_tax", F.col("l_quantity").cast("long").alias("at")).agg(F.round(F.avg("l_discount") * 10, 9).alias("w"), F.avg("l_extendedprice").alias("s"))
    return fit.tongues(line, key=["l_tax"], at="at", winding="w", strength="s").withColumn("mean", F.round("mean", 3))


_LOCK_ROWS = """
r AS (SELECT l_returnflag AS program, cast(l_quantity AS BIGINT) AS p1, cast(round(l_discount * 100) AS BIGINT) AS p2, cast(round(l_tax * 100) AS BIGINT) AS p3, l_extendedprice / 50000 AS w, l_extendedprice AS s FROM lineitem),
v AS (SELECT program, unnest(['p1', 'p2', 'p3']) AS param, unnest([p1, p2, p3]) AS level FROM r), c AS (SELECT program, param, level, count(*) AS n FROM v GROUP BY 1, 2, 3),
m AS (SELECT program, param, arg_min(level, (-n, level)) AS mode, count(*) AS levels FROM c GROUP BY 1, 2),
x AS (SELECT program, unnest(['p1', 'p1', 'p2']) AS a, unnest(['p2', 'p3', 'p3']) AS b, unnest([p1, p1, p2]) AS level, unnest([p2, p3, p3]) AS at_b, unnest(['p3', 'p2', 'p1']) AS other, unnest([p3, p2, p1]) AS held, w, s FROM r),
y AS (SELECT x.* FROM x JOIN m ON m.program = x.program AND m.param = other AND m.mode = held JOIN m ma ON ma.program = x.program AND ma.param = a AND ma.levels >= 4 JOIN m mb ON mb.program = x.program AND mb.param = b AND mb.levels >= 4),
l AS (SELECT program, a, b, level, at_b, round(avg(w), 9) AS w, avg(s) AS s, count(*) AS n FROM y GROUP BY 1, 2, 3, 4, 5), l2 AS (SELECT * FROM l WHERE (SELECT sum(n) FROM l k WHERE k.program = l.program AND k.a = l.a AND k.b = l.b) >= 8),
f AS (SELECT *, list_min([{d: round(abs(w - round_even(w * 1, 0) / 1), 12), q: 1, p: cast(round_even(w * 1, 0) AS INT)}, {d: round(abs(w - round_even(w * 2, 0) / 2), 12), q: 2, p: cast(round_even(w * 2, 0) AS INT)}, {d: round(abs(w - round_even(w * 3, 0) / 3), 12), q: 3, p: cast(round_even(w * 3, 0) AS INT)}, {d: round(abs(w - round_even(w * 4, 0) / 4), 12), q: 4, p: cast(round_even(w * 4, 0) AS INT)}]) AS f FROM l2),
k AS (SELECT *, CASE WHEN f.d <= 0.0125 THEN f.p || '/' || f.q END AS lock FROM f),
g AS (SELECT *, row_number() OVER (PARTITION BY program, a, b, level ORDER BY at_b) - row_number() OVER (PARTITION BY program, a, b, level, lock ORDER BY at_b) AS g FROM k),
t AS (SELECT program, a, b, level, any_value(f.p) AS p, any_value(f.q) AS q, (min(at_b) + max(at_b)) / 2 AS centre, max(at_b) - min(at_b) AS width, avg(s) AS mean, count(*) AS levels FROM g WHERE lock IS NOT NULL GROUP BY program, a, b, level, lock, g HAVING count(*) >= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY program, a, b, p, q ORDER BY width DESC, level DESC, centre DESC) AS i FROM t)
"""


def lock_rows(spark: SparkSession, d: str) -> DataFrame:
    """Measurements with a winding number and its strength."""
    return measurements(spark, d).withColumns({"w": F.col("price") / 50000, "s": F.col("price")})


@register("WITH " + _LOCK_ROWS + " SELECT program, a, b, p, q, level, centre, width, round(mean, 3) AS mean, levels FROM o WHERE i = 1")
def lock_maps(spark: SparkSession, d: str) -> DataFrame:
    """Widest locked stretch of each ratio for every pair of settings, the third at its most frequent value."""
    made = profiles.lock_maps(lock_rows(spark, d), key=["program"], params=["p1", "p2", "p3"], winding="w", strength="s")
    return made.withColumn("mean", F.round("mean", 3))


_SQL = {n: oracle(n) for n in ("fit_parameters", "assigned_axes", "pair_strengths", "lock_maps")}


@register(f"""
WITH pa AS (SELECT f.program, string_agg(f.param || ':' || kind || ':' || driver || ':' || axis || ':' || cliffs, ',' ORDER BY f.param) AS parameters FROM ({_SQL['fit_parameters']}) f JOIN ({_SQL['assigned_axes']}) x ON x.program = f.program AND x.param = f.param GROUP BY 1),
i AS (SELECT program, string_agg(a || '-' || b || ':' || cells, ',' ORDER BY a, b) AS interactions FROM ({_SQL['pair_strengths']}) WHERE strength >= 0.05 GROUP BY 1),
k AS (SELECT program, count(*) AS locks, max(width) AS widest FROM ({_SQL['lock_maps']}) GROUP BY 1), n AS (SELECT l_returnflag AS program, count(*) AS rows FROM lineitem GROUP BY 1)
SELECT program, rows, parameters, coalesce(interactions, '') AS interactions, coalesce(locks, 0) AS locks, widest FROM n JOIN pa USING (program) LEFT JOIN i USING (program) LEFT JOIN k USING (program)
""")
def profile_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each program's whole profile, saved as one nested document, loaded again and read: parameters, interactions, lock maps."""
    path = shared_path(spark, "profiles")
    made = profiles.fit_profile(lock_rows(spark, d), key="program", params=["p1", "p2", "p3"], metrics=METRICS, signatures=SIGNATURES, response="price", winding="w", strength="s", keep=["l_orderkey", "l_linenumber"])
    profiles.save_profiles(made, path, key="program")
    p = profiles.load_profiles(spark, path).select("program", "profile.*")
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    parameter = joined("parameters", lambda x: F.concat_ws(":", x["param"], x["kind"], x["driver"], x["axis"], x["cliffs"].cast("string")))
    pair = joined("interactions", lambda x: F.concat(x["a"], F.lit("-"), x["b"], F.lit(":"), x["cells"].cast("string")))
    return p.select("program", "rows", parameter.alias("parameters"), pair.alias("interactions"), F.size("lock_maps").cast("long").alias("locks"), F.array_max("lock_maps.width").alias("widest"))
