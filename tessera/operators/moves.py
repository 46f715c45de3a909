"""Did a parameter's steps move what is measured? Steps are scored against matched step-free frames of their take.

A step lands somewhere in the `span` frames that end at its frame. Its score is the change of the output over the span, less the
median of the step-free spans nearest to it in the change of the source, in units of their scale; its p-value is its place
among the scores of all step-free spans. p-values of a pool of steps are combined by Fisher's method, shrunk by their serial
dependence, at the better of some lags, against a bound for all tests of all takes together.

A take may be any share of the rows: sweeps, ranks and neighbours are dealt by ranges of a take.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.special import gamma_tail_z, normal_cdf, normal_quantile
from tessera.operators.windows import before, dealt, meetings, running
from tessera.session import kept

LIVE, NOOP = "live", "noop"
LAGS, EARLY, SIGMA = (0, 1), -1, 3.0
TARGET = ["take", "param", "pool", "lag", "span", "frame"]


def step_pools(steps: DataFrame, *, reach: int) -> DataFrame:
    """Distinct steps (take, param, frame, span) in pools, with `alone` and, for pools that never land alone, `partners`.

    Pool `live` holds steps judged live; one is alone if no other parameter's live step meets its window. Pool `dead` holds
    steps proven to do nothing whose windows keep more than `reach` frames from every live window, their own parameter's
    included; one is alone if no step of another parameter meets it. Steps of any other verdict are in no pool. Where no step
    of a pool is alone, partners are the parameters whose steps meet it.
    """
    s = steps.where(F.col("verdict").isin(LIVE, NOOP)).select("take", "param", "frame", "span", (F.col("frame") - F.col("span") + 1).alias("first"), (F.col("verdict") == LIVE).alias("live"))
    s = kept(s)
    live = s.where("live")
    wide = live.select("take", (F.col("first") - reach).alias("first"), (F.col("frame") + reach).alias("frame"))
    plain = lambda df: df.select("take", "param", "first", "frame", "span").distinct()
    quiet = meetings(plain(s.where("not live")), wide, key=["take"], first="first", last="frame").where("met = 0").drop("met")
    made = []
    for pool, own, rivals in (("live", plain(live), live), ("dead", quiet, s)):
        of_take = meetings(own, rivals, key=["take"], first="first", last="frame").withColumnRenamed("met", "all_met")
        of_both = meetings(own, rivals, key=["take", "param"], first="first", last="frame")
        both = kept(of_take.join(of_both, ["take", "param", "first", "frame", "span"]).withColumn("free", F.col("all_met") == F.col("met")))
        group = both.groupBy("take", "param").agg(F.max("free").alias("_any"))
        joint = both.join(group.where("not _any"), ["take", "param"]).select("take", F.col("param").alias("own"), "first", "frame")
        others = rivals.select("take", "param").distinct()
        asked = joint.join(others, "take").where("own <> param").distinct()
        beside = meetings(asked, rivals, key=["take", "param"], first="first", last="frame").where("met > 0")
        partners = beside.groupBy("take", F.col("own").alias("param")).agg(F.array_sort(F.collect_set("param")).alias("partners"))
        made.append(both.join(group, ["take", "param"]).join(partners, ["take", "param"], "left").select("take", "param", F.lit(pool).alias("pool"), "frame", "span", (F.col("free") | ~F.col("_any")).alias("alone"), "partners"))
    return made[0].unionByName(made[1])


def changes(frames: DataFrame, spans: list[int]) -> DataFrame:
    """take, frame, span, d_out and d_src: absolute changes over each span."""
    now = frames.select("take", "frame", "out", "src", F.explode(F.array(*[F.lit(s) for s in spans])).alias("span"))
    then = frames.select("take", F.col("frame").alias("_then"), F.col("out").alias("_out"), F.col("src").alias("_src"))
    both = now.withColumn("_then", F.col("frame") - F.col("span")).join(then, ["take", "_then"])
    return both.select("take", "frame", "span", F.abs(F.col("out") - F.col("_out")).alias("d_out"), F.abs(F.col("src") - F.col("_src")).alias("d_src")).where("d_out is not null and d_src is not null")


def _nearest_scores(table: pa.Table, quantum: float) -> pa.Table:
    """Residual and scale of the targets of a group from its controls, the k nearest in the source, itself left out."""
    column = lambda name: table.column(name).to_numpy(zero_copy_only=False)
    target, rank, src, out, frame = (column(c) for c in ("is_target", "rank", "d_src", "d_out", "frame"))
    control = np.flatnonzero(~target)
    control = control[np.argsort(rank[control])]
    at = np.flatnonzero(target)
    k = int(column("k")[0])
    base = int(rank[control[0]]) if len(control) else 0
    residual, spread = np.full(len(at), np.nan), np.full(len(at), np.nan)
    step = max(1, 2_000_000 // (2 * k + 2))
    for i in range(0, len(at) if len(control) else 0, step):
        own = at[i : i + step]
        place = rank[own][:, None] - k - 1 + np.arange(2 * k + 2) - base
        there = (place >= 0) & (place < len(control))
        near = control[np.clip(place, 0, len(control) - 1)]
        far = np.where(there & (frame[near] != frame[own][:, None]), np.abs(src[near] - src[own][:, None]), np.inf)
        pick = np.argsort(far, axis=1, kind="stable")[:, :k]
        value = np.where(np.isfinite(np.take_along_axis(far, pick, 1)), np.take_along_axis(out[near], pick, 1), np.nan)
        some = np.isfinite(value).any(1)
        centre = np.full(len(own), np.nan)
        centre[some] = np.nanmedian(value[some], axis=1)
        residual[i : i + step] = out[own] - centre
        wide = np.full(len(own), np.nan)
        wide[some] = 1.4826 * np.nanmedian(np.abs(value[some] - centre[some, None]), axis=1)
        spread[i : i + step] = np.maximum(wide, quantum)
    keep = table.select(TARGET).take(pa.array(at))
    return keep.append_column("residual", pa.array(residual)).append_column("score", pa.array(residual / spread))


def matched_scores(targets: DataFrame, controls: DataFrame, *, quantum: float, least: int = 1024) -> DataFrame:
    """targets with `residual` and `score` against the round(sqrt(n)) controls of their (take, span) nearest in d_src.

    Both have take, span, frame, d_out, d_src; targets have param, pool and lag as well. Controls are ranked by ranges, and a
    target meets the controls within k + 1 ranks of its place, in groups of ranks that overlap by as much.
    """
    kind = dict(targets.dtypes)
    blank = {c: F.lit(None).cast(kind[c]) for c in ("param", "pool", "lag")}
    rows = targets.withColumns({"is_target": F.lit(True), "w": F.lit(0)}).unionByName(controls.withColumns({**blank, "is_target": F.lit(False), "w": F.lit(1)}))
    key = ["take", "span"]
    rows = kept(rows)
    # targets come before controls of the same value; controls of one value in order of their frames
    rows = rows.withColumn("_o", F.when(F.col("is_target"), F.lit(-1).cast("long")).otherwise(F.col("frame").cast("long")))
    ranked = running(dealt(rows, key=key, by="d_src"), key=key, order=["d_src", "_o"], sums={"rank": "w"})
    count = controls.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    k = F.greatest(F.lit(1), F.rint(F.sqrt("n"))).cast("long")
    ranked = ranked.join(count.withColumn("k", k).withColumn("_size", F.greatest(F.lit(least), 4 * F.col("k"))), key)
    rank = F.when(F.col("is_target"), F.col("rank")).otherwise(F.col("rank") - 1)
    group = lambda r: F.floor(r / F.col("_size"))
    groups = F.when(F.col("is_target"), F.array(group(F.col("rank")))).otherwise(F.sequence(F.greatest(F.lit(0).cast("long"), group(F.col("rank") - F.col("k") - 1)), group(F.col("rank") + F.col("k") + 1)))
    sent = ranked.withColumn("rank", rank).withColumn("_group", F.explode(groups)).select(*TARGET, "is_target", "rank", "k", "d_src", "d_out", "_group")
    schema = ", ".join(f"{c} {kind[c]}" for c in TARGET) + ", residual double, score double"

    def score(table: pa.Table) -> pa.Table:
        return _nearest_scores(table, quantum)

    return sent.groupBy("take", "span", "_group").applyInArrow(score, schema)


def tail_p(scores: DataFrame, null: DataFrame, *, key: list[str]) -> DataFrame:
    """scores with `p`: the mid-p of each score among the null scores of its key, strictly inside (0, 1)."""
    rows = scores.withColumn("_w", F.lit(0)).unionByName(null.select(*key, "score").withColumn("_w", F.lit(1)), allowMissingColumns=True).withColumn("_asked", F.col("_w") == 0)
    rows = kept(rows)
    placed = running(dealt(rows, key=key, by="score"), key=key, order=["score"], sums={"_upto": "_w"})
    ties = placed.groupBy(*key, "score").agg(F.sum("_w").alias("_ties")).where("_ties > 0")
    count = null.groupBy(*key).agg(F.count("*").alias("_n"))
    found = placed.where("_asked").join(ties, [*key, "score"], "left").join(count, key)
    p = (F.col("_n") - F.col("_upto") + 0.5 * F.coalesce("_ties", F.lit(0)) + 0.5) / (F.col("_n") + 1)
    return found.withColumn("p", p).select(*scores.columns, "p")


def fisher(p: DataFrame, *, key: list[str], order: str, term: Column | None = None) -> DataFrame:
    """Per key: steps, effective, least_p and z of Fisher's combination of a column `p`, whose rows a number orders.

    term is -2 log p where p itself may be too small for a double.

    A first-order dependence r of the terms shrinks statistic and degrees of freedom to n (1 - r) / (1 + r) of n.
    """
    terms = kept(p.withColumn("_u", -2 * F.log("p") if term is None else term))
    pairs = before(dealt(terms, key=key, by=order), key=key, order=[order], value="_u", name="_v")
    n, mean = F.col("steps"), F.col("_s") / F.col("steps")
    s = pairs.groupBy(*key).agg(F.count("*").alias("steps"), F.min("p").alias("least_p"), F.sum("_u").alias("_s"), F.sum(F.col("_u") * F.col("_u")).alias("_q"), F.sum(F.col("_u") * F.col("_v")).alias("_c"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_u") + F.col("_v"))).alias("_e"), (F.max("_u") - F.min("_u") <= 1e-9 * F.max("_u")).alias("_flat"))
    r = (F.col("_c") - mean * F.col("_e") + (n - 1) * mean * mean) / (F.col("_q") - n * mean * mean)
    shrunk = F.least(n.cast("double"), F.greatest(F.lit(1.0), n * (1 - r) / (1 + r)))
    s = s.withColumn("effective", F.when((n < 3) | F.col("_flat"), n.cast("double")).otherwise(shrunk))
    z = _combined(F.col("_s") * F.col("effective") / n, F.col("effective"))
    return s.select(*key, "steps", "effective", "least_p", z.alias("z"))


def _combined(statistic: Column, effective: Column) -> Column:
    @F.arrow_udf("double")
    def run(s: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([gamma_tail_z(b, a / 2) for a, b in zip(s.to_pylist(), n.to_pylist())], pa.float64())

    return run(statistic, effective)


def acted_upon(frames: DataFrame, steps: DataFrame, *, spans: list[int], lags: tuple[int, ...] = LAGS, quantum: float = 1e-6, sigma: float = SIGMA) -> DataFrame:
    """One row a pool of steps (take, param, pool): did they move the output?

    frames: take, frame (0, 1, ...), out, src. steps: take, param, frame, span (one of `spans`) and verdict; those outside the
    measured frames are left out. `z` is the better one over the lags (`lag`), `moved` whether it passes the bound at `sigma`
    shared by all pools and lags; `before` is the z a frame before the steps, over those that no other step reaches there.
    `effect` is the mean residual, `unmatched` counts steps without controls, `jointly` those not tested alone.
    """
    size = frames.groupBy("take").agg(F.count("*").alias("_size"))
    late = max(0, *lags)
    inside = steps.join(size, "take").where((F.col("frame") - F.col("span") >= 0) & (F.col("frame") < F.col("_size") - max(lags))).drop("_size")
    inside = kept(inside)
    reached = inside.select("take", (F.col("frame") - F.col("span") + 1).alias("first"), (F.col("frame") + late).alias("last"))
    moved = kept(changes(frames, spans))
    clear = meetings(moved.select("take", "span", "frame", (F.col("frame") - F.col("span") + 1).alias("first"), F.col("frame").alias("last")), reached, key=["take"], first="first", last="last").where("met = 0")
    controls = moved.join(clear.select("take", "span", "frame"), ["take", "span", "frame"], "left_semi")

    pools = kept(step_pools(inside, reach=max(lags)))
    alone = pools.where("alone")
    at = lambda df, lag: df.select("take", "param", "pool", F.lit(lag).alias("lag"), "span", (F.col("frame") + lag).alias("frame"))
    ahead = alone.select("take", "param", "pool", "span", "frame", (F.col("frame") + EARLY).alias("first"))
    early = meetings(ahead.withColumn("last", F.col("first")), reached, key=["take"], first="first", last="last").where("met = 0")
    asked = at(early, EARLY)
    for lag in lags:
        asked = asked.unionByName(at(alone, lag))
    targets = kept(asked.join(moved, ["take", "span", "frame"]))
    none = controls.select("take", F.lit(None).cast(dict(targets.dtypes)["param"]).alias("param"), F.lit("").alias("pool"), F.lit(0).alias("lag"), "span", "frame", "d_out", "d_src")
    scored = kept(matched_scores(targets.unionByName(none), controls, quantum=quantum).where("score is not null and not isnan(score)"))
    p = tail_p(scored.where("pool <> ''"), scored.where("pool = ''"), key=["take", "span"])

    by = ["take", "param", "pool"]
    p = kept(p.withColumn("_at", F.col("span").cast("long") * (1 << 40) + F.col("frame")))
    found = fisher(p, key=[*by, "lag"], order="_at").join(p.groupBy(*by, "lag").agg(F.avg("residual").alias("effect")), [*by, "lag"])
    now, then = found.where(F.col("lag") != EARLY), found.where(F.col("lag") == EARLY).select(*by, F.col("z").alias("before"))
    best = now.groupBy(*by).agg(F.max_by(F.struct("lag", "steps", "effective", "least_p", "z", "effect"), F.struct("z", -F.col("lag"))).alias("b")).select(*by, "b.*")
    tested = pools.groupBy(*by).agg(F.count("*").alias("_all"), F.count_if("alone").alias("_alone"), F.first("partners", True).alias("partners"))
    measured = targets.where("pool <> ''").groupBy(*by, "lag").agg(F.count("*").alias("_kept"))
    tests = tested.agg(F.count("*").alias("_tests"))
    out = tested.join(best, by, "left").join(then, by, "left").join(measured, [*by, "lag"], "left").join(F.broadcast(tests))
    bound = _bound(F.col("_tests") * (len(lags) + 1), sigma)
    count = F.coalesce("steps", F.lit(0))
    return out.select(*by, count.alias("steps"), "effective", "least_p", F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("lag", F.lit(lags[0])).alias("lag"), bound.alias("critical"), (F.coalesce("z", F.lit(0.0)) > bound).alias("moved"), "before", "effect", F.when(F.col("partners").isNull(), F.col("_all") - F.col("_alone")).otherwise(F.col("_all")).alias("jointly"), "partners", (F.coalesce("_kept", "_alone") - count).alias("unmatched"))


def _bound(tests: Column, sigma: float) -> Column:
    """Normal score that none of so many tests passes with more than the upper tail probability of sigma."""
    tail = normal_cdf(-sigma)

    @F.arrow_udf("double")
    def run(count: pa.Array) -> pa.Array:
        return pa.array([-normal_quantile(tail / max(n, 1)) for n in count.to_pylist()], pa.float64())

    return run(tests)
