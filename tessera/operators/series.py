"""Series metrics: surprisal, autocorrelation, circular statistics, folds by phase."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def markov_surprisal(df: DataFrame, *, key: list[str], order_by: list[str], symbol: str, order: int = 2) -> DataFrame:
    """Per key: surprisal in bits of each symbol given the `order` before it, summed and averaged.

    Contexts are counted over the key; counting is two partial aggregates, no window over counts.
    """
    w = Window.partitionBy(*key).orderBy(*order_by)
    context = F.concat_ws(">", *[F.lag(symbol, k).over(w) for k in range(order, 0, -1)])
    rows = df.select(*key, F.col(symbol).alias("_s"), context.alias("_c"), F.row_number().over(w).alias("_i")).where(F.col("_i") > order)
    pair = rows.groupBy(*key, "_c", "_s").agg(F.count("*").alias("_n"))
    ctx = pair.groupBy(*key, "_c").agg(F.sum("_n").alias("_t"))
    bits = -F.log2(F.col("_n") / F.col("_t"))
    return pair.join(ctx, [*key, "_c"]).groupBy(*key).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * bits).alias("bits")).withColumn("rate", F.col("bits") / F.col("n"))


def entropy(df: DataFrame, *, key: list[str], symbol: str) -> DataFrame:
    """Entropy in bits of the symbols of each key."""
    counts = df.groupBy(*key, symbol).agg(F.count("*").alias("_n"))
    n = F.sum("_n")
    return counts.groupBy(*key).agg(n.alias("n"), (F.log2(n) - F.sum(F.col("_n") * F.log2("_n")) / n).alias("entropy"))


def autocorrelation(df: DataFrame, *, key: list[str], order_by: list[str], value: str, lags: list[int]) -> DataFrame:
    """Per key and lag: sum of products of deviations over their sum of squares."""
    mean = F.avg(value).over(Window.partitionBy(*key))
    w = Window.partitionBy(*key).orderBy(*order_by)
    off = df.select(*key, *order_by, (F.col(value) - mean).alias("_d"))
    lagged = off.select(*key, "_d", *[F.lag("_d", k).over(w).alias(f"_l{k}") for k in lags])
    total = lagged.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_q"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_p{k}") for k in lags])
    return total.select(*key, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("_q") > 0, F.coalesce(F.col(f"_p{k}"), F.lit(0.0)) / F.col("_q")).otherwise(F.lit(0.0)).alias("acf")) for k in lags])).alias("x")).select(*key, "n", "x.*")


def effective_n(df: DataFrame, *, key: list[str], order_by: list[str], value: str) -> DataFrame:
    """Effective size of an AR(1) series, n (1 - r) / (1 + r) within [1, n]."""
    r = autocorrelation(df, key=key, order_by=order_by, value=value, lags=[1])
    size = F.col("n") * (1 - F.col("acf")) / (1 + F.col("acf"))
    return r.select(*key, "n", F.col("acf").alias("lag1"), F.least(F.greatest(size, F.lit(1.0)), F.col("n").cast("double")).alias("effective"))


def circular(df: DataFrame, *, key: list[str], angle: str) -> DataFrame:
    """Per key: n, resultant length and mean direction of angles in radians."""
    a = df.groupBy(*key).agg(F.count(angle).alias("n"), F.avg(F.cos(angle)).alias("_c"), F.avg(F.sin(angle)).alias("_s"))
    return a.select(*key, "n", F.sqrt(F.col("_c") ** 2 + F.col("_s") ** 2).alias("resultant"), F.atan2("_s", "_c").alias("direction"))


def phase_fold(df: DataFrame, *, key: list[str], phase: str, value: str) -> DataFrame:
    """Share of each key's variance left after subtracting the mean of every phase bin."""
    cells = df.groupBy(*key, phase).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = cells.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("s").alias("_s"), F.sum("q").alias("_q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("_b"))
    return t.select(*key, "n", ((F.col("_q") - F.col("_b")) / (F.col("_q") - F.col("_s") * F.col("_s") / F.col("n"))).alias("left"))


def tail_midp(df: DataFrame, null: DataFrame, *, value: str, parts: int = 64) -> DataFrame:
    """df with the upper mid-p of its value in the empirical null: (count above + half the ties) / count.

    Both sides are counted by distinct value. Values are dealt to `parts` ranges by approximate quantiles of the null; order
    within a range is one window a range, order between ranges one window over the ranges' counts.
    """
    counts = null.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_null"))
    bounds = null.agg(F.coalesce(F.percentile_approx(value, F.array(*[F.lit(k / parts) for k in range(1, parts)])), F.array().cast("array<double>")).alias("_bounds"))
    asked = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v")).distinct().withColumn("_ask", F.lit(1))
    both = asked.join(counts, "_v", "full").join(F.broadcast(bounds)).withColumn("_part", F.size(F.filter("_bounds", lambda b: b < F.col("_v")))).withColumn("_null", F.coalesce("_null", F.lit(0)))
    sums = both.groupBy("_part").agg(F.sum("_null").alias("_own"))
    ahead = F.sum("_own").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))  # at most `parts` rows
    sums = sums.select("_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.sum("_own").over(Window.partitionBy()).alias("_all"))
    inside = F.coalesce(F.sum("_null").over(Window.partitionBy("_part").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = both.withColumn("_inside", inside).where("_ask = 1").join(F.broadcast(sums), "_part")
    p = (F.col("_ahead") + F.col("_inside") + F.col("_null") / F.lit(2.0).cast("double")) / F.col("_all")
    return df.join(placed.select("_v", p.alias("p")), F.col(value) == F.col("_v")).drop("_v")


def checkerboard_novelty(df: DataFrame, *, key: str, order: str, vector: str, half: int = 4, width: int = 4096) -> DataFrame:
    """Per row of a key: key, order, k (its place in the key, from 0) and novelty, a checkerboard of 2 * half rows around it.

    `order` is a long without repeats in a key. Rows are numbered in ranges of it and dealt by (key, bucket of numbers) with the
    rows that reach in from next door, so a key is many tasks. The kernel is an outer product, so its sum over cosines is the
    squared norm of one weighted sum of unit vectors.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("_k"), F.col(order).cast("long").alias("_o"), F.col(vector).cast("array<double>").alias("_x"))
    rows = rows.withColumn("_b", F.floor(F.col("_o") / width))
    before = F.sum("_n").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("_k", "_b").agg(F.count("*").alias("_n")).select(F.col("_k").alias("_sk"), F.col("_b").alias("_sb"), F.coalesce(before, F.lit(0)).alias("_at"))
    within = F.row_number().over(Window.partitionBy("_k", "_b").orderBy("_o")) - 1
    numbered = rows.withColumn("_in", within).join(starts, F.col("_k").eqNullSafe(F.col("_sk")) & (F.col("_b") == F.col("_sb"))).withColumn("_i", F.col("_at") + F.col("_in"))
    # row i is seen by the rows i - half + 1 to i + half
    seen = F.array_distinct(F.array(*[F.floor((F.col("_i") + s) / width) for s in (1 - half, 0, half)]))
    dealt = numbered.select("_k", "_o", "_i", "_x", F.explode(seen).alias("_b"))
    at = np.arange(2 * half)
    weight = np.where(at < half, -1.0, 1.0) * np.exp(-(((at - half + 0.5) / half) ** 2))

    def score(t: pa.Table) -> pa.Table:
        t = t.sort_by("_i")
        i = np.asarray(t.column("_i"))
        unit = np.array(t.column("_x").to_pylist(), np.float64)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
        padded = np.pad(unit, ((half, half), (0, 0)))
        total = sum(w * padded[k : k + len(unit)] for k, w in enumerate(weight))
        own = i // width == t.column("_b")[0].as_py()
        out = t.filter(pa.array(own)).select(["_k", "_o", "_i"]).rename_columns([key, order, "k"])
        return out.append_column("novelty", pa.array((total[own] ** 2).sum(1)))

    kind = df.select(F.col(key).alias("_k")).schema["_k"].dataType.simpleString()
    return dealt.groupBy("_k", "_b").applyInArrow(score, f"{key} {kind}, {order} long, k long, novelty double")
