"""What an output keeps of its source over a span: information on both sides, and how far its motion follows.

A series has one row a frame of a span: key, frame, s_si and s_ti of the source, o_si and o_ti of the output, null (or NaN) where
unmeasured. At lead k an output frame shows the source frame k earlier. Frames meet by a shuffle on (key, lead, frame) and serial
dependence is summed over ranges, so a span may be any share of the rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.special import normal_cdf, normal_quantile
from tessera.operators import moves
from tessera.operators.windows import before, dealt
from tessera.session import kept

LEADS, SIGMA = (0, 1), 3.0
_MEASURES = ("s_si", "s_ti", "o_si", "o_ti")


def critical(tests: int, sigma: float = SIGMA) -> float:
    """Normal score for so many tests together at the upper tail of sigma."""
    return -normal_quantile(normal_cdf(-sigma) / max(tests, 1))


def led(series: DataFrame, *, key: list[str], leads: list[int]) -> DataFrame:
    """key, lead, frame and the four measures, the source's taken `lead` frames earlier in the same span."""
    clean = series.select(*key, F.col("frame").cast("long").alias("frame"), *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in _MEASURES])
    lead = F.explode(F.array(*[F.lit(int(k)) for k in leads])).alias("lead")
    none = [F.lit(None).cast("double").alias(c) for c in _MEASURES]
    source = clean.select(*key, lead, "frame", "s_si", "s_ti", *none[2:]).withColumn("frame", F.col("frame") + F.col("lead"))
    output = clean.select(*key, lead, "frame", *none[:2], "o_si", "o_ti")
    return source.unionByName(output).groupBy(*key, "lead", "frame").agg(*[F.max(c).alias(c) for c in _MEASURES])


def lead_stats(series: DataFrame, *, key: list[str], leads: list[int]) -> DataFrame:
    """Per key and lead: frames, source_si, source_ti, output_si, output_ti (0 without frames), follow, effective and z.

    follow is the correlation of the two sides' s_ti and o_ti over the frames that have both; effective counts them as two
    first-order series; z is 0 for fewer than three frames or at most three effective ones.
    """
    by = [*key, "lead"]
    pairs = kept(led(series, key=key, leads=leads))
    both = F.col("s_si").isNotNull() & F.col("o_si").isNotNull()
    moved = F.col("s_ti").isNotNull() & F.col("o_ti").isNotNull()
    mean = lambda c, when, name: F.coalesce(F.avg(F.when(when, F.col(c))), F.lit(0.0)).alias(name)
    level = pairs.groupBy(*by).agg(F.count_if(moved).alias("frames"), mean("s_si", both, "source_si"), mean("s_ti", moved, "source_ti"), mean("o_si", both, "output_si"), mean("o_ti", moved, "output_ti"))
    rows = kept(pairs.where(moved).select(*by, "frame", F.struct(F.col("s_ti").alias("x"), F.col("o_ti").alias("y")).alias("_v")))
    lined = before(dealt(rows, key=by, by="frame"), key=by, order=["frame"], value="_v", name="_u")
    sums = [f(c, n) for c in "xy" for f, n in ((_squares, f"_q{c}"), (_products, f"_c{c}"), (_edges, f"_e{c}"), (_flat, f"_f{c}"))]
    serial = lined.groupBy(*by).agg(F.covar_pop("_v.x", "_v.y").alias("_co"), (F.stddev_pop("_v.x") * F.stddev_pop("_v.y")).alias("_sd"), *sums)
    s = level.join(serial, by, "left")
    n = F.col("frames")
    a, b = _serial(n, F.col("source_ti"), "x"), _serial(n, F.col("output_ti"), "y")
    # not corr(): it divides by zero where a side stands still
    s = s.withColumn("follow", F.when((n > 2) & ~F.col("_fx") & ~F.col("_fy"), F.try_divide("_co", "_sd")).otherwise(F.lit(0.0)))
    s = s.withColumn("_ab", F.coalesce(a * b, F.lit(0.0))).withColumn("effective", n * (1 - F.col("_ab")) / (1 + F.col("_ab")))
    held = F.greatest(F.lit(-1 + 1e-12), F.least(F.lit(1 - 1e-12), F.coalesce("follow", F.lit(0.0))))
    z = F.when((n > 2) & (F.col("effective") > 3), F.atanh(held) * F.sqrt(F.col("effective") - 3)).otherwise(F.lit(0.0))
    return s.select(*by, "frames", "source_si", "source_ti", "output_si", "output_ti", F.coalesce("follow", F.lit(0.0)).alias("follow"), "effective", z.alias("z"))


def _squares(c: str, name: str) -> Column:
    return F.sum(F.col(f"_v.{c}") * F.col(f"_v.{c}")).alias(name)


def _products(c: str, name: str) -> Column:
    return F.sum(F.col(f"_v.{c}") * F.col(f"_u.{c}")).alias(name)


def _edges(c: str, name: str) -> Column:
    """Sum of both members of all neighbouring pairs."""
    return F.sum(F.col(f"_v.{c}") + F.col(f"_u.{c}")).alias(name)


def _flat(c: str, name: str) -> Column:
    return (F.max(f"_v.{c}") == F.min(f"_v.{c}")).alias(name)


def _serial(n: Column, mean: Column, c: str) -> Column:
    """Lag-one correlation from a series' sums; 0 without variance or for fewer than three frames."""
    around = F.col(f"_c{c}") - mean * F.col(f"_e{c}") + (n - 1) * mean * mean
    return F.when((n > 2) & ~F.col(f"_f{c}"), F.coalesce(F.try_divide(around, F.col(f"_q{c}") - n * mean * mean), F.lit(0.0))).otherwise(F.lit(0.0))


def best_lead(stats: DataFrame, *, key: list[str]) -> DataFrame:
    """The lead of each key that follows best, the least on a tie."""
    rest = [c for c in stats.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct("z", (-F.col("lead")).alias("_l")))
    return stats.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")


def survival(series: DataFrame, *, key: list[str], leads: list[int] | tuple[int, ...] = LEADS) -> DataFrame:
    """One row a span: the statistics of its best lead, si_ratio and ti_ratio (null without source), and whether it follows."""
    best = best_lead(lead_stats(series, key=key, leads=list(leads)), key=key)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return best.withColumns({"si_ratio": ratio("output_si", "source_si"), "ti_ratio": ratio("output_ti", "source_ti"), "following": F.col("z") > critical(len(leads))})


def judged_bars(frames: DataFrame, *, key: list[str], noise_si: float, noise_ti: float) -> DataFrame:
    """Survival of each bar and why it cannot be shown: flashing, else flat, else frozen, else null.

    frames is a series whose key ends in the bar, with flashing (the change to this frame completes one), structured (the
    picture has more than one level; null where none was shown) and still (the bar's rows all true: it cannot be told from one
    picture held). A flash at a bar's first frame belongs to no bar. Flat: at most half of the shown frames structured, or
    output_si below the geometric mean of the source's and the noise's; frozen: the same of ti, or still without following.
    """
    first = frames.groupBy(*key).agg(F.min_by("flashing", "frame").alias("_edge"), F.count_if("flashing").alias("_flashes"), F.count("structured").alias("shown"), F.count_if("structured").alias("structured"), F.every("still").alias("_still"))
    bars = survival(frames, key=key).join(first, key)
    under = lambda kind, noise: F.col(f"output_{kind}") < F.sqrt(F.greatest(F.col(f"source_{kind}"), F.lit(0.0)) * noise)
    inner = F.col("_flashes") - F.when(F.col("_edge"), 1).otherwise(0)
    fault = F.when(inner > 0, "flashing").when((2 * F.col("structured") <= F.col("shown")) | under("si", noise_si), "flat").when((F.coalesce("_still", F.lit(False)) & ~F.col("following")) | under("ti", noise_ti), "frozen")
    return bars.withColumn("fault", fault).drop("_edge", "_flashes", "_still")


def shift_evidence(series: DataFrame, *, run: list[str], setting: str, ambiguity: int, leads: tuple[int, ...] = LEADS) -> DataFrame:
    """Per run, setting and shift 0 to ambiguity: the best of the leads, each shift frames later.

    Every offset (lead and shift) is scored once, whatever the number of shifts that use it.
    """
    key = [*run, setting]
    stats = kept(lead_stats(series, key=key, leads=sorted({k + a for k in leads for a in range(ambiguity + 1)})))
    uses = F.explode(F.array(*[F.struct(F.lit(a).alias("shift"), F.lit(k + a).alias("_at")) for k in leads for a in range(ambiguity + 1)]))
    return best_lead(stats.withColumn("_use", uses).where(F.col("_use._at") == F.col("lead")).withColumn("shift", F.col("_use.shift")).drop("_use"), key=[*key, "shift"])


def pooled_follow(series: DataFrame, *, run: list[str], setting: str, ambiguity: int, leads: tuple[int, ...] = LEADS) -> DataFrame:
    """Per run and shift: settings that could follow (more than two frames), and their evidence combined into one pooled_z.

    A setting's p-value is that of its best lead times the leads tried, at most 1; p-values are combined by Fisher in logs,
    in the order of the settings (a number), shrunk by their serial dependence. A shift without settings has 0.
    """
    found = kept(shift_evidence(series, run=run, setting=setting, ambiguity=ambiguity, leads=leads))
    log_p = F.least(F.lit(0.0), math.log(len(leads)) + _log_tail(F.col("z")))
    terms = found.where("frames > 2").select(*run, "shift", setting, log_p.alias("_lp")).withColumn("p", F.exp("_lp"))
    z = moves.fisher(terms, key=[*run, "shift"], order=setting, term=-2 * F.col("_lp"))
    shifts = found.select(*run, "shift").distinct()
    return shifts.join(z, [*run, "shift"], "left").select(*run, "shift", F.coalesce("steps", F.lit(0)).alias("settings"), F.coalesce("z", F.lit(0.0)).alias("pooled_z"))


def select_shift(pooled: DataFrame, *, run: list[str], shifts: int) -> DataFrame:
    """Per run: best (the least on a tie), its margin over the next in units of a difference's spread, critical, and shift.

    shift is null where the margin does not pass the bound for all shifts; a run of one shift has no margin and keeps it.
    """
    order = Window.partitionBy(*run).orderBy(F.desc("pooled_z"), "shift")
    # a run has `shifts` rows
    top = pooled.withColumn("_k", F.row_number().over(order)).withColumn("_next", F.lead("pooled_z").over(order)).where("_k = 1")
    margin = (F.col("pooled_z") - F.col("_next")) / math.sqrt(2)
    bound = critical(shifts)
    clear = margin.isNull() | (margin > bound)
    return top.select(*run, F.col("shift").alias("best"), "pooled_z", margin.alias("margin_z"), F.lit(bound).alias("critical_z"), F.when(clear, F.col("shift")).alias("shift"))


def log_tail(z: float) -> float:
    """Log of the normal's upper tail; far out by its asymptotic series."""
    if z < 30:
        return math.log(0.5 * math.erfc(z / math.sqrt(2)))
    far = z * z
    return -far / 2 - math.log(z * math.sqrt(2 * math.pi)) + math.log1p(-1 / far + 3 / far**2)


def _log_tail(z: Column) -> Column:
    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([log_tail(v) for v in values.to_pylist()], pa.float64())

    return run(z)
