"""Joins that SQL engines lack as operators: as-of, hold, interval, ordinal, nearest and temporal validity.

Ordered joins are one shuffle each. A key may hold a large share of all rows, so ordered state never runs over a whole key:
rows are dealt by (key, time bucket), and what one bucket hands to the next is one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def asof(left: DataFrame, right: DataFrame, *, key: list[str], time: str, values: list[str], tie: str, forward: bool = False, strict: bool = True, width: int = DAY, prefix: str = "r_") -> DataFrame:
    """left with the `values` of the last right row before its time (next one after it if forward), null if none.

    time is a long column of both sides; tie orders right rows of equal time (the later, or forward the earlier, wins).
    """
    sign = -1 if forward else 1
    payload = F.struct(*[F.col(c) for c in values])
    l = left.select(*key, (sign * F.col(time)).alias("_t"), F.lit(0 if strict else 1).alias("_f"), F.lit(0).cast("long").alias("_tie"), F.struct("*").alias("_l"))
    r = right.select(*key, (sign * F.col(time)).alias("_t"), F.lit(1 if strict else 0).alias("_f"), (sign * F.col(tie)).cast("long").alias("_tie"), payload.alias("_r"))
    rows = l.unionByName(r, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / width))
    part = Window.partitionBy(*key, "_b")
    seen = rows.withColumn("_in", F.last("_r", True).over(part.orderBy("_t", "_f", "_tie").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_l").isNotNull())
    last = rows.groupBy(*key, "_b").agg(F.max_by(F.col("_r"), F.when(F.col("_r").isNotNull(), F.struct("_t", "_tie"))).alias("_last"))
    carry = last.withColumn("_carry", F.last("_last", True).over(Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    found = seen.join(carry, [*key, "_b"]).withColumn("_m", F.coalesce("_in", "_carry"))
    return found.select("_l.*", *[F.col(f"_m.{c}").alias(prefix + c) for c in values])


def interval_join(points: DataFrame, spans: DataFrame, *, time: str, start: str, end: str, width: int, key: list[str] | None = None, how: str = "inner") -> DataFrame:
    """points joined to the spans [start, end] that hold their time, through buckets of `width`.

    Spans are copied to the buckets they touch; take a width of about the usual span.
    """
    key = key or []
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("_b", F.floor(F.col(time) / width))
    same = [p[c] == s[c] for c in [*key, "_b"]]
    on = (p[time] >= s[start]) & (p[time] <= s[end])
    for c in same:
        on = on & c
    joined = p.join(s.select(*[F.col(c) if c in (start, end, "_b") or c in key else F.col(c) for c in s.columns]), on, how)
    drop = [s[c] for c in [*key]] if how not in ("left_semi", "left_anti") else []
    out = joined.drop(*drop) if drop else joined
    return out.drop("_b")


def ordinal_join(a: DataFrame, b: DataFrame, *, key: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """Full outer join of the k-th row of a key in a with its k-th row in b; the column k counts from 1."""
    number = lambda df, order: df.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return number(a, order_a).join(number(b, order_b), [*key, "k"], "full")


def nearest(targets: DataFrame, rows: DataFrame, *, key: list[str], at: str, time: str, tie: str, reach: int, width: int | None = None) -> DataFrame:
    """For each target the row of its key within `reach` whose time is nearest; the later row wins a tie."""
    width = width or 2 * reach
    t = targets.withColumn("_lo", F.col(at) - reach).withColumn("_hi", F.col(at) + reach)
    t = t.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    r = rows.withColumn("_b", F.floor(F.col(time) / width))
    pairs = t.join(r, [*key, "_b"]).where((F.col(time) >= F.col("_lo")) & (F.col(time) <= F.col("_hi")))
    value = F.struct(*[F.col(c) for c in r.columns if c not in [*key, "_b"]])
    best = pairs.groupBy(*key, at).agg(F.min_by(value, F.struct(F.abs(F.col(time) - F.col(at)), -F.col(time), -F.col(tie))).alias("_best"))
    return best.select(*key, at, "_best.*")


def hold(writes: DataFrame, grid: DataFrame, *, key: list[str], time: str, value: str, tie: str, default: Column, width: int = DAY) -> DataFrame:
    """Zero-order hold: the last written value at or before each grid time, the default before the first."""
    held = asof(grid, writes, key=key, time=time, values=[value], tie=tie, strict=False, width=width)
    return held.withColumn("r_" + value, F.coalesce("r_" + value, default))
