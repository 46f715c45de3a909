"""Robust aggregates and pieces of the profile fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def broadcast_if_small(df: DataFrame, most: int = 1_000) -> DataFrame:
    """df marked for a broadcast if it has at most `most` rows, which are then held as they are; else df, for a plain join."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def exact_median(df: DataFrame, *, key: list[str], value: str) -> DataFrame:
    """Per key: n and the exact median, for few keys with very many rows each.

    A quantile sketch, whose rank error is bounded by a 2,000th of the rows, brackets the middle by a 250th of them. Values
    under the bracket are counted, and only distinct values inside it are put in order, so no task holds a key's values.
    """
    v = df.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_v"))
    ends = v.groupBy(*key).agg(F.count("*").alias("n"), F.percentile_approx("_v", F.array(F.lit(0.498), F.lit(0.502)), F.lit(2_000)).alias("_e"))
    v = v.join(broadcast_if_small(ends), key)
    low, high = F.get("_e", F.lit(0)), F.get("_e", F.lit(1))
    # one row a value inside the bracket, and one for all values under it (null); those over it are not needed
    part = v.where(F.col("_v") <= high).select(*key, "n", F.when(F.col("_v") >= low, F.col("_v")).alias("_v")).groupBy(*key, "n", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = part.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    holds = lambda rank: (F.col("_from") < rank) & (F.col("_to") >= rank)
    lower, upper = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    middle = (F.max(F.when(holds(lower), F.col("_v"))) + F.max(F.when(holds(upper), F.col("_v")))) / 2
    return ranked.groupBy(*key, "n").agg(middle.alias("median"))


def robust_scale(df: DataFrame, *, key: list[str], value: str, dealt: bool = True) -> DataFrame:
    """Per key: n, median and scale, which is 1.4826 * MAD, else the standard deviation, else 1.

    dealt: few keys with very many rows each, in four passes over df, which should be cheap to read; else two passes with
    a key's distinct values in one task.
    """
    rows = df.select(*key, F.col(value).alias("_x"))
    if not dealt:
        middle = rows.groupBy(*key).agg(F.count("_x").alias("n"), F.median("_x").alias("median"), F.stddev_pop("_x").alias("_sd"))
        off = rows.join(middle, key).groupBy(*key).agg(F.median(F.abs(F.col("_x") - F.col("median"))).alias("_mad"))
        return _scaled(middle.join(off, key), key)
    middle = broadcast_if_small(exact_median(rows, key=key, value="_x").join(rows.groupBy(*key).agg(F.stddev_pop("_x").alias("_sd")), key))
    off = exact_median(rows.join(middle, key).select(*key, F.abs(F.col("_x") - F.col("median")).alias("_x")), key=key, value="_x").select(*key, F.col("median").alias("_mad"))
    return _scaled(off.join(middle, key), key)


def _scaled(df: DataFrame, key: list[str]) -> DataFrame:
    scale = F.when(F.col("_mad") > 0, MAD_SCALE * F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    return df.select(*key, "n", "median", scale.alias("scale"))


def mode_smallest(df: DataFrame, *, key: list[str], value: str) -> DataFrame:
    """Per key the most frequent value, the smallest on a tie, and its count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("b"))
    return best.select(*key, F.col("b.v").alias("mode"), (-F.col("b.n")).alias("times"))


def replicate_noise(df: DataFrame, *, setting: list[str], value: str, floor: float = 0.05, least: int = 4) -> DataFrame:
    """One row: noise of replicated settings, 1.4826 * median |residual from the setting's mean|, with a floor."""
    means = df.groupBy(*setting).agg(F.avg(value).alias("_mean"), F.count(value).alias("_n")).where("_n > 1")
    off = df.join(means, setting).select(F.abs(F.col(value) - F.col("_mean")).alias("r"))
    return off.agg(F.count("*").alias("rows"), F.median("r").alias("_m")).select("rows", F.when(F.col("rows") >= least, F.greatest(F.lit(floor), MAD_SCALE * F.col("_m"))).otherwise(F.lit(floor)).alias("noise"))


def pointwise_fit(df: DataFrame, *, key: list[str], x: str, y: str) -> DataFrame:
    """Per key R2 of the conditional mean of y on the levels of x: 1 - within / total sums of squares."""
    cells = df.groupBy(*key, x).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))
    total = cells.groupBy(*key).agg(F.sum("n").alias("rows"), F.count("*").alias("levels"), F.sum("s").alias("_s"), F.sum("q").alias("_q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("_between"))
    all_ss = F.col("_q") - F.col("_s") * F.col("_s") / F.col("rows")
    return total.select(*key, "rows", "levels", F.when(all_ss > 0, 1 - (F.col("_q") - F.col("_between")) / all_ss).otherwise(F.lit(0.0)).alias("r2"))


def additive_residual(df: DataFrame, *, a: str, b: str, y: str) -> DataFrame:
    """Interaction of two settings: for each cell its mean less the additive model (row + column - grand mean).

    Means are over rows, all from the sums and counts of the cells, which are read once.
    """
    sets = df.groupBy(a, b).agg(F.count(y).alias("n"), F.sum(y).alias("_s"))
    mean = lambda *by: F.sum("_s").over(Window.partitionBy(*by)) / F.sum("n").over(Window.partitionBy(*by))
    cell = F.col("_s") / F.col("n")
    # a grid of two settings is small; its margins are windows over cells
    return sets.select(a, b, "n", cell.alias("cell"), (cell - mean(a) - mean(b) + mean()).alias("residual"))


def kernel_curve(df: DataFrame, *, x: str, y: str, widths: list[float]) -> DataFrame:
    """Nadaraya-Watson means at the distinct levels of x, the width chosen by leave-one-out error.

    Levels are few (a setting's grid), so levels meet levels; rows enter as counts and sums. Width 0 means own level only.
    """
    level = df.groupBy(F.col(x).cast("double").alias("x")).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))
    w = F.explode(F.array(*[F.lit(float(v)) for v in widths]))
    other = level.select(F.col("x").alias("x2"), F.col("n").alias("n2"), F.col("s").alias("s2"))
    pairs = level.join(other).select("*", w.alias("width"))
    distance = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2"))
    weight = F.when(F.col("width") > 0, F.exp(-distance / (2 * F.col("width") * F.col("width")))).otherwise(F.when(F.col("x") == F.col("x2"), F.lit(1.0)).otherwise(F.lit(0.0)))
    fit = pairs.groupBy("width", "x", "n", "s", "q").agg(F.sum(weight * F.col("s2")).alias("a"), F.sum(weight * F.col("n2")).alias("b"))
    # leaving a row y out of its level: (a - y) / (b - 1)
    error = fit.where("b > 1").groupBy("width").agg((F.sum((F.col("q") - 2 * F.col("s") * _loo() + F.col("n") * _loo() * _loo()))).alias("_e"))
    best = error.agg(F.min_by("width", F.struct("_e", "width")).alias("width"))
    return fit.join(F.broadcast(best), "width").select("x", "n", "width", (F.col("a") / F.col("b")).alias("curve"))


def _loo() -> Column:
    """Mean fit of a level's rows with one row of mean size left out."""
    return (F.col("a") - F.col("s") / F.col("n")) / (F.col("b") - 1)


def spearman(df: DataFrame, *, key: list[str], x: str, y: str) -> DataFrame:
    """Per key the correlation of mid-ranks."""
    from tessera.operators.windows import midrank

    rx = midrank(df, key=key, value=x).withColumnRenamed("midrank", "_rx")
    both = midrank(rx, key=key, value=y).withColumnRenamed("midrank", "_ry")
    return both.groupBy(*key).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


def stability_regions(df: DataFrame, *, label: str, params: list[str]) -> DataFrame:
    """Per label: count and the least and greatest of every parameter."""
    return df.groupBy(label).agg(F.count("*").alias("n"), *[f(p).alias(f"{name}_{p}") for p in params for name, f in (("min", F.min), ("max", F.max))])


def hysteresis(df: DataFrame, *, at: str, up: str, value: str) -> DataFrame:
    """Per setpoint visited in both passes: mean of the up pass less mean of the down pass."""
    return df.groupBy(at).agg(F.avg(F.when(F.col(up), F.col(value))).alias("up_mean"), F.avg(F.when(~F.col(up), F.col(value))).alias("down_mean")).where("up_mean is not null and down_mean is not null").withColumn("gap", F.col("up_mean") - F.col("down_mean"))


def kfold_error(df: DataFrame, *, fold: Column, folds: int, group: list[str], value: str) -> DataFrame:
    """Held-out error of group means, fold by fold: the mean without a fold is total less the fold's own sums."""
    marked = df.withColumn("fold", fold)
    own = marked.groupBy(*group, "fold").agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    total = own.groupBy(*group).agg(F.sum("_n").alias("_tn"), F.sum("_s").alias("_ts"))
    held = own.join(total, group).where("_tn > _n").select(*group, "fold", ((F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("_n"))).alias("_guess"))
    return marked.join(held, [*group, "fold"]).groupBy("fold").agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col(value) - F.col("_guess")) ** 2)).alias("rms"), F.median(F.abs(F.col(value) - F.col("_guess"))).alias("median_abs"))


def within(df: DataFrame, spread: str, key: list[str]) -> Column:
    """Sum of a column over its key, for shares."""
    return F.sum(spread).over(Window.partitionBy(*key))
