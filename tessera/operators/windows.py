"""Gaps and islands, fills, ranks and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import kept

def islands(df: DataFrame, *, key: list[str], order: list[str], same: Column | str) -> DataFrame:
    """df with `island`: a number that rises (from 1) whenever `same` differs from the row before."""
    w = Window.partitionBy(*key).orderBy(*order)
    value = F.col(same) if isinstance(same, str) else same
    new = F.when(F.lag(value).over(w).eqNullSafe(value) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(df: DataFrame, *, key: list[str], order: list[str], same: str) -> DataFrame:
    """One row a run: key, island, value, length, first and last order value."""
    numbered = islands(df, key=key, order=order, same=same)
    return numbered.groupBy(*key, "island", same).agg(F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def longest_run(df: DataFrame, *, key: list[str], order: list[str], same: str) -> DataFrame:
    """The longest run of each key, the first on a tie."""
    best = F.max_by(F.struct(same, "length", "first", "last"), F.struct(F.col("length"), -F.col("island")))
    return runs(df, key=key, order=order, same=same).groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def gap_segments(df: DataFrame, *, key: list[str], time: str, tie: str, factor: float = 1.5) -> DataFrame:
    """df with `segment`: a new one where the interval exceeds `factor` times the key's median interval."""
    w = Window.partitionBy(*key).orderBy(time, tie)
    gaps = df.withColumn("_gap", F.col(time) - F.lag(time).over(w))
    median = gaps.groupBy(*key).agg(F.median("_gap").alias("_median"))
    cut = F.when(F.col("_gap") > factor * F.col("_median"), 1).otherwise(0)
    return gaps.join(median, key).withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap", "_median", "_cut")


def fill(df: DataFrame, *, key: list[str], order: list[str], value: str) -> DataFrame:
    """df with `filled`: the last known value, before the first known one the next."""
    w = Window.partitionBy(*key).orderBy(*order)
    back = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("filled", F.coalesce(F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), back))


def midrank(df: DataFrame, *, key: list[str], value: str) -> DataFrame:
    """df with `midrank` in [0, 1]: ties share the mean of their ranks, a lone row has 0.5.

    Ranks come from counts of distinct values, so a window sees each value once.
    """
    counts = df.groupBy(*key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key).orderBy(value)
    below = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_rows = F.sum("_n").over(Window.partitionBy(*key))
    ranked = counts.select(*key, value, F.when(all_rows > 1, (below + (F.col("_n") - 1) / F.lit(2.0).cast("double")) / (all_rows - 1).cast("double")).otherwise(F.lit(0.5)).alias("midrank"))
    return df.join(ranked, [*key, value])


def pooled_midrank(df: DataFrame, *, value: str, ranges: int = 64) -> DataFrame:
    """df with `midrank` in [0, 1] over all rows together: ties share the mean of their ranks, a lone row has 0.5.

    Distinct values are dealt by ranges, ranked within their range, and moved up by the rows of the ranges before, so no
    task sees more than a range; only the ranges' row counts meet in one window.
    """
    edges = df.agg(F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(10_000)).alias("_e"))
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")).join(F.broadcast(edges))
    counts = counts.withColumn("_range", F.size(F.filter("_e", lambda x: x < F.col(value)))).drop("_e")
    own = counts.groupBy("_range").agg(F.sum("_n").alias("_rows"))
    before = own.select("_range", (F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy()).alias("_all"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("_before") + F.col("_below") + (F.col("_n") - 1) / F.lit(2.0).cast("double")
    ranked = counts.withColumn("_below", below).join(F.broadcast(before), "_range")
    return df.join(ranked.select(value, F.when(F.col("_all") > 1, rank / (F.col("_all") - 1).cast("double")).otherwise(F.lit(0.5)).alias("midrank")), value)


def rank_bins(df: DataFrame, *, value: str, bins: int) -> DataFrame:
    """df with `bin`: distinct numbers in rank order, cut into `bins` equal shares; ranks go from range to range of the values."""
    distinct = kept(df.where(F.col(value).isNotNull()).select(F.lit(0).alias("_all"), value, F.lit(1).alias("_one")).distinct())
    ranked = running(dealt(distinct, key=["_all"], by=value), key=["_all"], order=[value], sums={"_rank": "_one"})
    count = distinct.agg(F.count("*").alias("_count"))
    binned = ranked.join(F.broadcast(count)).select(value, F.floor((F.col("_rank") - 1) * bins / F.col("_count")).cast("int").alias("bin"))
    return df.join(binned, value)


def sweep_cover(spans: DataFrame, *, key: list[str], start: str, end: str) -> DataFrame:
    """Pieces [from, to) of each key and how many spans [start, end) cover them; pieces without cover are left out."""
    marks = spans.select(*key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("m")).groupBy(*key, F.col("m.at").alias("at")).agg(F.sum("m.d").alias("d"))
    w = Window.partitionBy(*key).orderBy("at")
    covered = marks.select(*key, F.col("at").alias("from"), F.lead("at").over(w).alias("to"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cover"))
    return covered.where("to is not null and cover > 0")


def dealt(df: DataFrame, *, key: list[str], by: str, ranges: int = 32) -> DataFrame:
    """df with `_range`: each key's rows cut by about equal quantiles of a number, so that a hot key is many tasks.

    The cuts come from a sketch; any cuts are right, as what is computed over ranges carries exact sums from one to the next.
    """
    cuts = df.groupBy(*key).agg(F.percentile_approx(F.col(by).cast("double"), F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(1_000)).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda x: x < F.col(by).cast("double")))
    return df.join(cuts, key).withColumn("_range", F.when(F.col(by).isNull(), 0).otherwise(below)).drop("_cuts")


def running(df: DataFrame, *, key: list[str], order: list[str], sums: dict[str, str], peers: bool = True, fold: str = "sum") -> DataFrame:
    """df, which has `_range`, with running sums over a key in order: ranges apart, each from the sums of those before.

    sums maps new columns to summed ones; order begins with what ranges were dealt by. With peers, rows equal in order count as
    one place. fold is sum, max or min.
    """
    of = {"sum": F.sum, "max": F.max, "min": F.min}[fold]
    both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}[fold]
    own = df.groupBy(*key, "_range").agg(*[of(c).alias(f"_s_{new}") for new, c in sums.items()])
    ahead = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = own.select(*key, "_range", *[of(f"_s_{new}").over(ahead).alias(f"_s_{new}") for new in sums])
    w = Window.partitionBy(*key, "_range").orderBy(*order)
    w = w.rangeBetween(Window.unboundedPreceding, 0) if peers else w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select("*", *[of(c).over(w).alias(new) for new, c in sums.items()])
    return rows.join(start, [*key, "_range"]).withColumns({new: both(F.col(new), F.col(f"_s_{new}")) for new in sums}).drop(*[f"_s_{new}" for new in sums])


def before(df: DataFrame, *, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df, which has `_range`, with the value of the row before in a key's order, null for the first."""
    w = Window.partitionBy(*key, "_range").orderBy(*order)
    last = df.groupBy(*key, "_range").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carry = last.select(*key, "_range", F.lag("_last").over(Window.partitionBy(*key).orderBy("_range"))[value].alias("_carry"))
    rows = df.select("*", F.lag(value).over(w).alias(name), (F.row_number().over(w) == 1).alias("_first"))
    return rows.join(carry, [*key, "_range"]).withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(name))).drop("_first", "_carry")


def meetings(queries: DataFrame, spans: DataFrame, *, key: list[str], first: str, last: str) -> DataFrame:
    """queries with `met`: how many spans [first, last] of their key meet their own [first, last].

    A sweep: spans that began by a query's end, less those that ended before its start, as running counts over ranges. No
    pair of intervals is formed. Queries must be distinct rows.
    """
    mark = lambda at, kind, opened, closed, side: F.struct(F.col(at).cast("long").alias("at"), F.lit(kind).alias("kind"), F.lit(opened).alias("opened"), F.lit(closed).alias("closed"), F.lit(side).alias("side"))
    ends = spans.select(*key, F.explode(F.array(mark(first, 0, 1, 0, 0), mark(last, 2, 0, 1, 0))).alias("m"))
    asks = queries.select(*key, F.struct("*").alias("_q"), F.explode(F.array(mark(last, 1, 0, 0, 1), mark(first, 1, 0, 0, -1))).alias("m"))
    points = kept(asks.unionByName(ends, allowMissingColumns=True).select(*key, "_q", "m.*"))
    swept = running(dealt(points, key=key, by="at"), key=key, order=["at", "kind"], sums={"_open": "opened", "_shut": "closed"})
    found = F.sum(F.when(F.col("side") > 0, F.col("_open")).otherwise(-F.col("_shut")))
    return swept.where("_q is not null").groupBy("_q").agg(found.alias("met")).select("_q.*", "met")


def medians(df: DataFrame, *, key: list[str], value: str) -> DataFrame:
    """Per key the exact median, for many keys of which some may be hot: distinct values are counted, and dealt by ranges."""
    counts = kept(df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n")))
    upto = running(dealt(counts, key=key, by=value), key=key, order=[value], sums={"_to": "_n"}).join(counts.groupBy(*key).agg(F.sum("_n").alias("_all")), key)
    holds = lambda rank: (F.col("_to") >= F.expr(rank)) & (F.col("_to") - F.col("_n") < F.expr(rank))
    ends = F.max(F.when(holds("(_all + 1) div 2"), F.col(value))) + F.max(F.when(holds("_all div 2 + 1"), F.col(value)))
    return upto.groupBy(*key).agg((ends / 2).alias("median"))
