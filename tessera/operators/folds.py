"""Ordered folds: rate limiting, change counting, routing. State that SQL windows cannot carry goes through `aggregate`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limiter(df: DataFrame, *, key: list[str], time: str, tie: str, value: str, gap: int) -> DataFrame:
    """At most one write of each key in `gap`: a write inside the gap waits, and only the latest waiting one goes out.

    A waiting write leaves at the end of the gap. Two gaps of silence leave nothing waiting and nothing due, so a key's
    writes are cut there; the fold holds (due, waiting value) and runs over the ordered writes of a stretch as one array.
    A stretch must fit a row. Returns key, at, value.
    """
    silence = F.col(time) - F.lag(time).over(Window.partitionBy(*key).orderBy(time, tie)) >= 2 * gap
    started = F.sum(F.when(silence, 1).otherwise(0)).over(Window.partitionBy(*key).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0))
    item = F.struct(F.col(time).alias("t"), F.col(tie).alias("o"), F.col(value).alias("v"))
    ordered = df.withColumn("_stretch", started).groupBy(*key, "_stretch").agg(F.sort_array(F.collect_list(item)).alias("w"))
    vt = df.schema[value].dataType.simpleString()
    start = F.expr(f"named_struct('due', cast(null as bigint), 'wait', cast(null as {vt}), 'out', cast(array() as array<struct<at: bigint, value: {vt}>>))")

    def step(s: Column, x: Column) -> Column:
        out = F.when(s["wait"].isNotNull() & (x["t"] >= s["due"]), F.concat(s["out"], F.array(F.struct(s["due"].alias("at"), s["wait"].alias("value"))))).otherwise(s["out"])
        due = F.when(s["wait"].isNotNull() & (x["t"] >= s["due"]), s["due"] + gap).otherwise(s["due"])
        free = due.isNull() | (x["t"] >= due)
        return F.struct(
            F.when(free, x["t"] + gap).otherwise(due).alias("due"),
            F.when(free, F.lit(None).cast(vt)).otherwise(x["v"]).alias("wait"),
            F.when(free, F.concat(out, F.array(F.struct(x["t"].alias("at"), x["v"].alias("value"))))).otherwise(out).alias("out"),
        )

    done = lambda s: F.when(s["wait"].isNotNull(), F.concat(s["out"], F.array(F.struct(s["due"].alias("at"), s["wait"].alias("value"))))).otherwise(s["out"])
    return ordered.select(*key, F.explode(F.aggregate("w", start, step, done)).alias("x")).select(*key, "x.at", "x.value")


def change_counter(df: DataFrame, *, key: list[str], order: str, rate: str, one: int, width: int = 65_536) -> DataFrame:
    """df with `changes`: how often the running sum of rates crosses a whole number in this row.

    rate is a long in parts of `one`, `order` a long without repeats in a key. Rows are dealt by (key, range of the order);
    a range starts from the sums of those before, so a key is many tasks.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / width))
    sums = rows.groupBy(*key, "_b").agg(F.sum(rate).alias("_own"))
    before = F.coalesce(F.sum("_own").over(Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*key, "_b", before.alias("_at"))
    within = F.sum(rate).over(Window.partitionBy(*key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    total = rows.withColumn("_in", within).join(starts, [*key, "_b"]).withColumn("_total", F.col("_at") + F.col("_in"))
    return total.withColumn("changes", F.expr(f"_total div {one} - (_total - {rate}) div {one}")).drop("_b", "_in", "_at", "_total")


def last_per_slot(df: DataFrame, *, slot: list[str], time: str, tie: str, width: int, value: str) -> DataFrame:
    """Last value of each slot and step of time, without those equal to the step before."""
    step = df.groupBy(*slot, F.floor(F.col(time) / width).alias("step")).agg(F.max_by(value, F.struct(time, tie)).alias(value))
    before = F.lag(value).over(Window.partitionBy(*slot).orderBy("step"))
    return step.withColumn("_p", before).where(F.col("_p").isNull() | (F.col("_p") != F.col(value))).drop("_p")


def sliding_count(df: DataFrame, *, key: list[str], time: str, span: int, spans: int = 24) -> DataFrame:
    """df with `in_span`: rows of the key in (time - span, time].

    Rows are dealt by (key, bucket of `spans` spans), those of a bucket's last span to the next bucket as well, so a key is
    many tasks.
    """
    width = span * spans
    own = F.floor(F.col(time) / width)
    seen = F.when(F.floor((F.col(time) + span - 1) / width) > own, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = df.withColumn("_own", own).withColumn("_b", F.explode(seen))
    counted = dealt.withColumn("in_span", F.count("*").over(Window.partitionBy(*key, "_b").orderBy(time).rangeBetween(-span + 1, 0)))
    return counted.where("_own = _b").drop("_own", "_b")


def cheapest_route(costs: DataFrame, *, stage: str, state: str, cost: str, stages: list[int], move: float) -> DataFrame:
    """Least-cost path that picks a state at every stage, moving to another state costing `move` (Viterbi).

    One pass a stage over the states (few); only the best and the own predecessor can lead to a state.
    Returns one row: total and path.
    """
    rows = costs.select(F.col(stage).alias("_g"), F.col(state).alias("s"), F.col(cost).cast("double").alias("c"))
    best = rows.where(F.col("_g") == stages[0]).select("s", F.col("c").alias("total"), F.array("s").alias("path"))
    for g in stages[1:]:
        top = best.agg(F.min(F.struct("total", "s", "path")).alias("b"))
        here = rows.where(F.col("_g") == g).join(F.broadcast(top)).join(best.select("s", F.col("total").alias("t0"), F.col("path").alias("p0")), "s", "left")
        stay = F.col("t0").isNotNull() & (F.col("t0") <= F.col("b.total") + move)
        best = here.select("s", (F.col("c") + F.when(stay, F.col("t0")).otherwise(F.col("b.total") + move)).alias("total"), F.concat(F.when(stay, F.col("p0")).otherwise(F.col("b.path")), F.array("s")).alias("path"))
    return best.agg(F.min(F.struct("total", "s", "path")).alias("b")).select(F.col("b.total").alias("total"), F.array_join(F.col("b.path").cast("array<string>"), ">").alias("path"))
