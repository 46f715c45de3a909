"""How long a take still moves after a step: every lag after the steps against where they settled, lag by lag.

The steps of all takes of a program are pooled, and apart by parameter. Each lag has a signed-rank test; lags form a fixed
sequence, so only the rows of a program (the pool and its parameters) share the family-wise bound.

A take, a program or a lag may hold any share of the rows: segments, medians and ranks are dealt by ranges.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.special import normal_cdf, normal_quantile
from tessera.operators.windows import before, dealt, medians, running
from tessera.session import kept

POOLED, LANDING, MEASURED, SIGMA = 0, 2, 2, 3.0
#: up to so many steps without ties or zeros are tested by the exact distribution of their rank sum
EXACT = 50


def changed_steps(writes: DataFrame, *, key: list[str], order: list[str], start: int = 0) -> DataFrame:
    """writes (key, param, value and the order, which begins with a number) that differ from what their slot held before.

    A slot holds `start` before its first write; a null value is no write.
    """
    slots = [*key, "param"]
    rows = kept(writes.where(F.col("value").isNotNull()))
    seen = before(dealt(rows, key=slots, by=order[0]), key=slots, order=order, value="value", name="_held")
    return seen.where(F.col("value") != F.coalesce("_held", F.lit(start))).select(*writes.columns)


def differences(scores: DataFrame, steps: DataFrame, *, key: list[str]) -> DataFrame:
    """key, at, param, lag and d: scores after each step less the median score of where it settled.

    scores has a row for every frame of a take (frame from 0, score null where unmeasured). A step's quiet period runs to the
    next step or the take's end; lags in its first half are compared with the median of its second half, and left out where
    that has no score. param is 0 where several steps landed together.
    """
    landed = steps.where(F.col("frame") >= 0).groupBy(*key, "frame").agg(F.count("*").alias("_n"), F.min("param").alias("param"))
    landed = landed.select(*key, F.col("frame").alias("at"), F.when(F.col("_n") == 1, F.col("param")).otherwise(POOLED).cast("int").alias("param"))
    marked = scores.join(landed.withColumn("frame", F.col("at")).withColumnRenamed("at", "_mark"), [*key, "frame"], "left")
    owned = running(dealt(kept(marked), key=key, by="frame"), key=key, order=["frame"], sums={"at": "_mark"}, fold="max")
    owned = kept(owned.where("at is not null").select(*key, "at", (F.col("frame") - F.col("at")).alias("lag"), "score"))
    width = owned.groupBy(*key, "at").agg(F.max("lag").alias("_last"))
    halves = owned.join(width, [*key, "at"]).withColumn("_half", F.expr("(_last + 1) div 2"))
    settled = medians(halves.where("lag >= _half"), key=[*key, "at"], value="score").withColumnRenamed("median", "_settled")
    early = halves.where("lag < _half and score is not null").join(settled, [*key, "at"]).join(landed, [*key, "at"])
    return early.select(*key, "at", "param", "lag", (F.col("score") - F.col("_settled")).alias("d"))


def signed_rank(df: DataFrame, *, key: list[str], value: str) -> DataFrame:
    """Per key with a value other than zero: steps (rows), plus (rank sum of the positive), z, and tail where the test is exact.

    tail is half the two-sided p-value: of the exact distribution for up to 50 values without ties or zeros, when z is its normal
    score; else null, z being the normal approximation with ties. Zeros count as steps but have no rank.
    """
    size = F.abs(F.col(value))
    counts = kept(df.where(F.col(value).isNotNull()).groupBy(*key, size.alias("_a")).agg(F.count("*").alias("_n"), F.count_if(F.col(value) > 0).alias("_up")))
    ranked = running(dealt(counts.where("_a > 0"), key=key, by="_a"), key=key, order=["_a"], sums={"_to": "_n"})
    rank = F.col("_to") - (F.col("_n") - 1) / F.lit(2.0).cast("double")
    sums = ranked.withColumn("_r", rank).groupBy(*key).agg(F.sum("_n").alias("_m"), F.max("_n").alias("_tie"), F.sum(F.col("_up") * F.col("_r")).alias("plus"), F.sum((2 * F.col("_up") - F.col("_n")) * F.col("_r")).alias("_s"), F.sum(F.col("_n") * F.col("_r") * F.col("_r")).alias("_q"))
    made = sums.join(counts.groupBy(*key).agg(F.sum("_n").alias("steps")), key)
    exact = (F.col("steps") <= EXACT) & (F.col("steps") == F.col("_m")) & (F.col("_tie") == 1)
    made = made.withColumn("tail", F.when(exact, _exact_tail(F.when(exact, F.col("steps")), F.col("plus"))))
    z = F.when(F.col("tail").isNotNull(), _score(F.col("tail"))).otherwise(F.abs(F.col("_s")) / F.sqrt("_q"))
    return made.select(*key, "steps", "plus", z.alias("z"), "tail")


@cache
def _tails(n: int) -> np.ndarray:
    """Of n untied steps, the smaller tail at each rank sum: how many of the 2^n sign patterns are as far out, as a share."""
    ways = np.ones(1)
    for rank in range(1, n + 1):
        ways = np.append(ways, np.zeros(rank)) + np.append(np.zeros(rank), ways)
    below = np.cumsum(ways) / 2.0**n
    return np.minimum(0.5, np.minimum(below, below[::-1]))


def _exact_tail(steps: Column, plus: Column) -> Column:
    @F.arrow_udf("double")
    def run(n: pa.Array, w: pa.Array) -> pa.Array:
        return pa.array([None if a is None else float(_tails(a)[round(b)]) for a, b in zip(n.to_pylist(), w.to_pylist())], pa.float64())

    return run(steps, plus)


def _score(tail: Column) -> Column:
    @F.arrow_udf("double")
    def run(p: pa.Array) -> pa.Array:
        return pa.array([None if v is None else -normal_quantile(v) for v in p.to_pylist()], pa.float64())

    return run(tail)


def critical(tests: int, sigma: float = SIGMA) -> float:
    """Normal score that none of so many tests passes by chance with more than the upper tail of sigma."""
    return -normal_quantile(normal_cdf(-sigma) / max(tests, 1))


def least_steps(tests: int, sigma: float = SIGMA) -> int:
    """Steps that a two-sided signed-rank test needs before it can pass the bound for so many tests at all."""
    return math.ceil(1 - math.log2(2 * normal_cdf(-sigma) / max(tests, 1)))


def _of_tests(tests: Column, kind: str, of) -> Column:
    @F.arrow_udf(kind)
    def run(count: pa.Array) -> pa.Array:
        return pa.array([of(n) for n in count.to_pylist()])

    return run(tests)


def lag_tests(diffs: DataFrame, *, program: list[str], sigma: float = SIGMA) -> DataFrame:
    """program, param (0: all steps pooled), lag, steps, plus, z, tail, tests (rows of the program), critical and departs."""
    apart = F.when(F.col("param") > POOLED, F.array(F.lit(POOLED), F.col("param"))).otherwise(F.array(F.lit(POOLED)))
    rows = diffs.select(*program, F.explode(apart).alias("param"), "lag", "d")
    found = kept(signed_rank(rows, key=[*program, "param", "lag"], value="d"))
    tests = diffs.groupBy(*program, "param").agg(F.lit(1).alias("_one")).groupBy(*program).agg((1 + F.count_if(F.col("param") > POOLED)).cast("long").alias("tests"))
    tests = tests.withColumn("critical", _of_tests(F.col("tests"), "double", lambda n: critical(n, sigma)))
    return found.join(tests, program).withColumn("departs", F.col("z") > F.col("critical"))


def settles(tests: DataFrame, *, program: list[str], landing: int = LANDING, measured: int = MEASURED, sigma: float = SIGMA) -> DataFrame:
    """Per program: settle, least, next_steps, bounded and hold, from its lag_tests.

    A row moves to the last lag it departs at in sequence: the landing lags are one step of it, each later lag counts only if
    the one before departed. settle is the latest of all rows; it is bounded where the lag after it had steps enough to depart.
    """
    tests = kept(tests)
    row = [*program, "param"]
    place = F.row_number().over(Window.partitionBy(*row).orderBy("lag"))
    # few rows: one for each lag at which a row departs
    late = tests.where(F.col("departs") & (F.col("lag") >= landing)).select(*row, "lag", place.alias("_k")).where(F.col("lag") == F.col("_k") + landing - 1)
    late = late.groupBy(*row).agg(F.max("lag").alias("_late"))
    early = tests.where(F.col("departs") & (F.col("lag") < landing)).groupBy(*row).agg(F.max("lag").alias("_early"))
    moving = early.join(late, row, "left").groupBy(*program).agg(F.max(F.coalesce("_late", "_early")).alias("_moving"))
    each = tests.groupBy(*program).agg(F.max("tests").alias("tests"))
    found = each.join(moving, program, "left").withColumn("settle", F.coalesce("_moving", F.lit(0)))
    after = tests.where(F.col("param") == POOLED).select(*program, (F.col("lag") - 1).alias("settle"), F.col("steps").alias("_next"))
    found = found.join(after, [*program, "settle"], "left").withColumn("next_steps", F.coalesce("_next", F.lit(0)))
    least = _of_tests(F.col("tests"), "long", lambda n: least_steps(n, sigma))
    found = found.withColumn("least", least)
    return found.select(*program, F.col("settle").cast("long").alias("settle"), "least", "next_steps", (F.col("next_steps") >= F.col("least")).alias("bounded"), (F.col("settle") + measured).cast("long").alias("hold"))
