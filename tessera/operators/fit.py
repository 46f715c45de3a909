"""The profile fit over long rows (key, row, metric, value): standardised metrics, level curves, axes and interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.robust import MAD_SCALE, broadcast_if_small, exact_median

NOISE = 0.05


def long_metrics(rows: DataFrame, *, keep: list[str], metrics: list[str]) -> DataFrame:
    """One row a metric; a metric that is absent is a null value."""
    return rows.select(*keep, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")).select(*keep, "_m.*")


def metric_matrix(long: DataFrame, *, key: list[str]) -> DataFrame:
    """long with `z`: missing values at the median, constant metrics left out, the rest robustly standardised.

    Adds median, scale (1.4826 * MAD, else the standard deviation, else 1) and span (of z, 1 where it is 0).
    """
    by = [*key, "metric"]
    ends = long.groupBy(*by).agg(F.min("value").alias("_low"), F.max("value").alias("_high")).where("_high > _low")
    # programs and metrics are few and rows many: medians by bracket, so no task holds a metric's values
    middle = broadcast_if_small(exact_median(long, key=by, value="value").drop("n").join(ends, by))
    filled = long.join(middle, by).withColumn("value", F.coalesce("value", "median"))
    mad = exact_median(filled.select(*by, F.abs(F.col("value") - F.col("median")).alias("_off")), key=by, value="_off").select(*by, F.col("median").alias("_mad"))
    spread = broadcast_if_small(filled.groupBy(*by).agg(F.stddev_pop("value").alias("_sd")).join(mad, by))
    scale = F.when(F.col("_mad") > 0, MAD_SCALE * F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    out = filled.join(spread, by).withColumn("scale", scale)
    return out.withColumn("z", (F.col("value") - F.col("median")) / F.col("scale")).withColumn("span", (F.col("_high") - F.col("_low")) / F.col("scale")).drop("_low", "_high", "_mad", "_sd")


def level_curves(matrix: DataFrame, *, key: list[str], params: list[str]) -> DataFrame:
    """Mean z at each level of every parameter: key, param, level, metric, n, curve, span."""
    levels = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("long").alias("level")) for p in params]))
    return matrix.select(*key, "metric", "z", "span", levels.alias("_l")).groupBy(*key, "_l.param", "_l.level", "metric").agg(F.count("*").alias("n"), F.avg("z").alias("curve"), F.first("span").alias("span"))


def effects(curves: DataFrame, *, key: list[str], noise: float = NOISE) -> DataFrame:
    """Range of each metric's curve over a parameter, over the noise and over the metric's span."""
    reach = F.max("curve") - F.min("curve")
    return curves.groupBy(*key, "param", "metric").agg((reach / noise).alias("sensitivity"), (reach / F.first("span")).alias("effect"))


def parameter_fits(curves: DataFrame, *, key: list[str], noise: float = NOISE, cliff_iqr: float = 1.5, monotonic: float = 0.9, steps: int = 16) -> DataFrame:
    """Per parameter: levels, kind, driver (most sensitive metric), sensitivity, rho, monotonic, dead zone and cliffs.

    rho is the rank correlation of level and driver curve over the levels that move beyond the noise; a dead zone is the
    longest stretch of two or more steps in which no metric moves; a cliff is a step where some metric moves beyond the
    upper quartile of its steps by cliff_iqr quartile ranges and the noise. A level grid is short, so windows go over it.
    """
    by = [*key, "param"]
    e = effects(curves, key=key, noise=noise)
    driver = e.groupBy(*by).agg(F.min(F.struct((-F.round("sensitivity", 9)).alias("s"), F.col("metric").alias("m"))).alias("d")).select(*by, F.col("d.m").alias("driver"), (-F.col("d.s")).alias("sensitivity"))
    along = Window.partitionBy(*by, "metric").orderBy("level")
    steps_of = curves.withColumn("move", F.abs(F.col("curve") - F.lag("curve").over(along))).withColumn("before", F.lag("level").over(along))
    # rank correlation of the driver's moving levels
    moving = steps_of.join(driver, by).where((F.col("metric") == F.col("driver")) & (F.col("move").isNull() | (F.col("move") > noise)))
    level_rank = F.row_number().over(Window.partitionBy(*by).orderBy("level"))
    same = F.count("*").over(Window.partitionBy(*by, F.col("curve")))
    curve_rank = F.rank().over(Window.partitionBy(*by).orderBy("curve")) + (same - 1) / 2
    rho = moving.select(*by, level_rank.alias("a"), curve_rank.alias("b")).groupBy(*by).agg(F.when(F.count("*") > 2, F.corr("a", "b")).otherwise(F.lit(1.0)).alias("rho"))
    # cliffs
    moves = steps_of.where("move is not null")
    limit = moves.groupBy(*by, "metric").agg(F.percentile("move", F.lit(0.25)).alias("q1"), F.percentile("move", F.lit(0.75)).alias("q3"))
    over = moves.join(limit, [*by, "metric"]).withColumn("over", F.col("move") > F.col("q3") + cliff_iqr * (F.col("q3") - F.col("q1")) + noise)
    step = over.groupBy(*by, "level", "before").agg(F.bool_or("over").alias("cliff"), F.every(F.col("move") <= noise).alias("flat"))
    cliffs = step.groupBy(*by).agg(F.count_if("cliff").alias("cliffs"))
    run = step.withColumn("_g", F.row_number().over(Window.partitionBy(*by).orderBy("level")) - F.row_number().over(Window.partitionBy(*by, "flat").orderBy("level"))).where("flat")
    runs = run.groupBy(*by, "_g").agg(F.count("*").alias("k"), F.min("before").alias("a"), F.max("level").alias("b")).where("k >= 2")
    dead = runs.groupBy(*by).agg(F.min(F.struct((-F.col("k")).alias("k"), "a", "b")).alias("d")).select(*by, F.col("d.a").alias("dead_from"), F.col("d.b").alias("dead_to"))
    levels = curves.groupBy(*by).agg(F.count_distinct("level").alias("levels"), F.min("level").alias("_a"), F.max("level").alias("_b"))
    kind = F.when(F.col("levels") <= 1, "unused").when((F.col("levels") == 2) & F.col("_a").isin(0) & F.col("_b").isin(1023), "boolean").when(F.col("levels") - F.when(F.col("levels") > 2, 1).otherwise(0) <= steps, "quantized").otherwise("continuous")
    out = levels.withColumn("kind", kind).join(driver, by).join(rho, by, "left").join(cliffs, by, "left").join(dead, by, "left")
    strong = F.coalesce(F.round(F.abs("rho"), 9) >= monotonic, F.lit(False))
    return out.select(*by, "levels", "kind", "driver", "sensitivity", "rho", strong.alias("monotonic"), F.coalesce("cliffs", F.lit(0).cast("long")).alias("cliffs"), "dead_from", "dead_to")


def assigned_axes(effect: DataFrame, *, key: list[str], signatures: dict[str, dict[str, float]], least: float = 0.3) -> DataFrame:
    """Per parameter the signature with the greatest cosine to its effects, UNASSIGNED under `least`.

    A key that ends in * names a family of metrics, and its weight is shared among those that are there.
    """
    by = [*key, "param"]
    flat = [(axis, name.rstrip("*"), name.endswith("*"), float(w)) for axis, parts in signatures.items() for name, w in parts.items()]
    known = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(n).alias("name"), F.lit(s).alias("wild"), F.lit(w).alias("w")) for a, n, s, w in flat]))
    hit = (F.col("metric") == F.col("s.name")) | (F.col("s.wild") & F.col("metric").startswith(F.col("s.name")))
    matched = effect.select(*by, "metric", "effect", known.alias("s")).where(hit).select(*by, "metric", "effect", "s.*")
    shared = matched.withColumn("w", F.col("w") / F.sqrt(F.count("*").over(Window.partitionBy(*by, "axis", "name"))))
    weight = shared.groupBy(*by, "axis", "metric").agg(F.max("w").alias("w"), F.first("effect").alias("effect"))
    length = effect.groupBy(*by).agg(F.sqrt(F.sum(F.col("effect") * F.col("effect"))).alias("_n"))
    cosine = weight.groupBy(*by, "axis").agg((F.sum(F.col("w") * F.col("effect")) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("c")).join(length, by).where("_n > 0")
    best = cosine.groupBy(*by).agg(F.min(F.struct((-F.round(F.col("c") / F.col("_n"), 9)).alias("c"), F.col("axis").alias("a"))).alias("b"))
    found = best.select(*by, (-F.col("b.c")).alias("similarity"), F.col("b.a").alias("axis"))
    named = F.when(F.col("similarity") >= least, F.col("axis")).otherwise("UNASSIGNED")
    return effect.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce(named, F.lit("UNASSIGNED")).alias("axis"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def pair_strengths(rows: DataFrame, *, key: list[str], params: list[str], y: str, bins: int = 4, filled: float = 0.75) -> DataFrame:
    """Per pair of parameters: RMS residual of the filled cell means against row mean + column mean - grand mean, over y's range.

    Means are over filled cells, each counting once; a grid with fewer than `filled` of its cells has strength 0.
    """
    out = rows
    for p in params:
        ranks = rows.select(*key, p).distinct().withColumn("_r", F.dense_rank().over(Window.partitionBy(*key).orderBy(p)) - 1)
        ranks = ranks.withColumn(f"_{p}", F.least(F.lit(bins - 1), F.expr(f"_r * {bins} div (max(_r) over (partition by {', '.join(key)}) + 1)"))).drop("_r")
        out = out.join(ranks, [*key, p])
    pairs = [(a, b) for i, a in enumerate(params) for b in params[i + 1 :]]
    cell = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{a}").alias("i"), F.col(f"_{b}").alias("j")) for a, b in pairs]))
    cells = out.select(*key, F.col(y).alias("_y"), cell.alias("c")).groupBy(*key, "c.a", "c.b", "c.i", "c.j").agg(F.avg("_y").alias("m"), F.min("_y").alias("_low"), F.max("_y").alias("_high"))
    pair = [*key, "a", "b"]
    mean = lambda *by: F.avg("m").over(Window.partitionBy(*pair, *by))
    residual = cells.select(*pair, "_low", "_high", (F.col("m") - mean("i") - mean("j") + mean()).alias("r"))
    full: Column = F.count("*") >= filled * bins * bins
    reach = F.max("_high") - F.min("_low")
    return residual.groupBy(*pair).agg(F.count("*").alias("cells"), F.when(full, F.sqrt(F.avg(F.col("r") * F.col("r"))) / F.when(reach > 0, reach).otherwise(F.lit(1.0))).otherwise(F.lit(0.0)).alias("strength"))


def tongues(line: DataFrame, *, key: list[str], at: str, winding: str, strength: str, most: int = 4) -> DataFrame:
    """Runs of two or more consecutive levels locked at one ratio of bounded denominator: key, p, q, centre, width, mean, levels.

    A winding locks at the nearest fraction if it lies within a quarter of 1 / (most * (most + 1)) of it.
    """
    w = F.col(winding)
    near = F.array_min(F.array(*[F.struct(F.round(F.abs(w - F.rint(w * q) / q), 12).alias("d"), F.lit(q).alias("q"), F.rint(w * q).cast("int").alias("p")) for q in range(1, most + 1)]))
    locked = line.withColumn("_f", near).withColumn("_l", F.when(F.col("_f.d") <= 0.25 / (most * (most + 1)), F.concat_ws("/", F.col("_f.p").cast("string"), F.col("_f.q").cast("string"))))
    run = F.row_number().over(Window.partitionBy(*key).orderBy(at)) - F.row_number().over(Window.partitionBy(*key, "_l").orderBy(at))
    runs = locked.withColumn("_g", run).where("_l is not null").groupBy(*key, "_l", "_g").agg(F.first("_f").alias("f"), F.min(at).alias("a"), F.max(at).alias("b"), F.avg(strength).alias("mean"), F.count("*").alias("levels")).where("levels >= 2")
    return runs.select(*key, F.col("f.p").alias("p"), F.col("f.q").alias("q"), ((F.col("a") + F.col("b")) / 2).alias("centre"), (F.col("b") - F.col("a")).alias("width"), "mean", "levels")
