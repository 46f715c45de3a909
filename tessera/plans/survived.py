"""What survives: each user is a take, each event a frame; hours of the day are the source, values the output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import survival
from tessera.operators.windows import before, dealt, running
from tessera.plans.catalogue import register
from tessera.plans.tables import events
from tessera.session import kept

BAR, RUNS, AMBIGUITY = 16, 4, 2
NOISE_SI, NOISE_TI = 0.5, 0.2
FLASH = 30.0

_FRAMES = """
WITH a AS (SELECT user_id AS take, row_number() OVER w - 1 AS frame, event_type, (epoch_us(ts) % 86400000000) / 3600000000.0 AS s, value AS o, lag((epoch_us(ts) % 86400000000) / 3600000000.0) OVER w AS ps, lag(value) OVER w AS po, lag(event_type) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT take, frame, event_type, o, s AS s_si, abs(s - ps) AS s_ti, CASE WHEN event_type <> 'signup' THEN o END AS o_si, CASE WHEN event_type <> 'signup' AND pe <> 'signup' THEN abs(o - po) END AS o_ti FROM a)"""


def _stats(key: str, leads: str) -> str:
    """SQL of the statistics at each lead of a series f."""
    serial = lambda c: f"CASE WHEN frames > 2 AND max{c} > min{c} THEN coalesce(c{c} / q{c}, 0) ELSE 0 END"
    around = lambda c: f"sum(({c} - m{c}) * (u{c} - m{c})) AS c{c}, sum(({c} - m{c}) * ({c} - m{c})) AS q{c}, max({c}) AS max{c}, min({c}) AS min{c}"
    return f""",
k AS (SELECT unnest({leads}) AS lead), p AS (SELECT o.*, k.lead, s.s_si AS x_si, s.s_ti AS x_ti FROM f o CROSS JOIN k LEFT JOIN f s ON {' AND '.join(f's.{c} = o.{c}' for c in key.split(', '))} AND s.frame = o.frame - k.lead),
l AS (SELECT {key}, lead, count(*) FILTER (x_ti IS NOT NULL AND o_ti IS NOT NULL) AS frames, coalesce(avg(x_si) FILTER (o_si IS NOT NULL AND x_si IS NOT NULL), 0) AS source_si, coalesce(avg(x_ti) FILTER (o_ti IS NOT NULL AND x_ti IS NOT NULL), 0) AS source_ti, coalesce(avg(o_si) FILTER (o_si IS NOT NULL AND x_si IS NOT NULL), 0) AS output_si, coalesce(avg(o_ti) FILTER (o_ti IS NOT NULL AND x_ti IS NOT NULL), 0) AS output_ti FROM p GROUP BY {key}, lead),
v AS (SELECT {key}, lead, x_ti AS x, o_ti AS y, lag(x_ti) OVER w AS ux, lag(o_ti) OVER w AS uy, avg(x_ti) OVER (PARTITION BY {key}, lead) AS mx, avg(o_ti) OVER (PARTITION BY {key}, lead) AS my FROM p WHERE x_ti IS NOT NULL AND o_ti IS NOT NULL WINDOW w AS (PARTITION BY {key}, lead ORDER BY frame)),
r AS (SELECT {key}, lead, sum((x - mx) * (y - my)) AS cxy, {around('x')}, {around('y')} FROM v GROUP BY {key}, lead),
g AS (SELECT l.*, CASE WHEN frames > 2 AND maxx > minx AND maxy > miny THEN cxy / sqrt(qx * qy) ELSE 0 END AS follow, ({serial('x')}) * ({serial('y')}) AS ab FROM l LEFT JOIN r USING ({key}, lead)),
e AS (SELECT *, frames * (1 - ab) / (1 + ab) AS effective FROM g),
t AS (SELECT *, CASE WHEN frames > 2 AND effective > 3 THEN atanh(greatest(-1 + 1e-12, least(1 - 1e-12, follow))) * sqrt(effective - 3) ELSE 0 END AS z FROM e)"""


def takes(spark: SparkSession, d: str) -> DataFrame:
    """A series of each user (take, frame), with its event type and value; a signup is a frame that was not measured."""
    e = events(spark, d).select(F.col("user_id").alias("take"), "t", "event_id", "event_type", F.col("value").alias("o"), (F.pmod("t", F.lit(86_400_000_000)) / 3.6e9).alias("s")).withColumn("_one", F.lit(1)).withColumn("_now", F.struct("event_type", "s", "o"))
    ranged = kept(dealt(e, key=["take"], by="t"))
    lined = before(ranged, key=["take"], order=["t", "event_id"], value="_now", name="_was")
    f = running(lined, key=["take"], order=["t", "event_id"], sums={"_n": "_one"})
    shown, was = F.col("event_type") != "signup", F.col("_was.event_type") != "signup"
    return kept(f.select("take", (F.col("_n") - 1).alias("frame"), "event_type", "o", F.col("s").alias("s_si"), F.abs(F.col("s") - F.col("_was.s")).alias("s_ti"), F.when(shown, F.col("o")).alias("o_si"), F.when(shown & was, F.abs(F.col("o") - F.col("_was.o"))).alias("o_ti")))


@register(_FRAMES.replace("f AS (SELECT take, frame,", f"f AS (SELECT take, frame // {BAR} AS bar, frame,") + _stats("take, bar", "[0, 1]") + f""",
b AS (SELECT take, bar, arg_max(struct_pack(lead := lead, frames := frames, source_si := source_si, source_ti := source_ti, output_si := output_si, output_ti := output_ti, follow := follow), (z, -lead)) AS b, max(z) AS z FROM t GROUP BY 1, 2),
c AS (SELECT take, bar, count(*) FILTER (o_ti > {FLASH}) - count(*) FILTER (o_ti > {FLASH} AND frame % {BAR} = 0) AS flashes, count(o_si) AS shown, count(*) FILTER (o_si > 1) AS structured, count(DISTINCT o_si) < 4 AS still FROM f GROUP BY 1, 2)
SELECT take, bar, b.lead AS lead, b.frames AS frames, round(b.follow, 5) AS follow, round(z, 5) AS z, round(b.output_si / nullif(b.source_si, 0), 5) AS si_ratio, round(b.output_ti / nullif(b.source_ti, 0), 5) AS ti_ratio, shown, structured,
CASE WHEN flashes > 0 THEN 'flashing' WHEN 2 * structured <= shown OR b.output_si < sqrt(greatest(b.source_si, 0) * {NOISE_SI}) THEN 'flat' WHEN (still AND NOT z > {survival.critical(2)!r}) OR b.output_ti < sqrt(greatest(b.source_ti, 0) * {NOISE_TI}) THEN 'frozen' END AS fault FROM b JOIN c USING (take, bar)
""")
def judged_bars(spark: SparkSession, d: str) -> DataFrame:
    """What each bar of sixteen frames of a take keeps of its source, and its fault; a bar of fewer than four values is still."""
    f = takes(spark, d).withColumn("bar", F.expr(f"frame div {BAR}"))
    few = f.groupBy("take", "bar").agg((F.count_distinct("o_si") < 4).alias("still"))
    rows = f.join(few, ["take", "bar"]).withColumn("flashing", F.coalesce(F.col("o_ti") > FLASH, F.lit(False))).withColumn("structured", F.col("o_si") > 1)
    bars = survival.judged_bars(rows, key=["take", "bar"], noise_si=NOISE_SI, noise_ti=NOISE_TI)
    return bars.select("take", "bar", "lead", "frames", *[F.round(c, 5).alias(c) for c in ("follow", "z", "si_ratio", "ti_ratio")], "shown", "structured", "fault")


@register(_FRAMES + _stats("take", str(list(range(AMBIGUITY + 2)))) + f""",
u AS (SELECT unnest(range(0, {AMBIGUITY + 1})) AS shift), y AS (SELECT t.*, shift FROM t JOIN u ON lead = shift OR lead = shift + 1)
SELECT take, cast(shift AS INTEGER) AS shift, arg_max(lead, (z, -lead)) AS lead, arg_max(frames, (z, -lead)) AS frames, round(max(z), 5) AS z FROM y GROUP BY 1, 2
""")
def shift_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How far each take follows its source at the leads of every shift."""
    found = survival.shift_evidence(takes(spark, d), run=[], setting="take", ambiguity=AMBIGUITY)
    return found.select("take", "shift", "lead", "frames", F.round("z", 5).alias("z"))


@register()
def pooled_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Takes dealt among runs: the evidence of every shift pooled over a run's takes, and the shift it selects, if one is clear."""
    rows = takes(spark, d).withColumn("run", F.col("take") % RUNS)
    pooled = kept(survival.pooled_follow(rows, run=["run"], setting="take", ambiguity=AMBIGUITY))
    chosen = survival.select_shift(pooled, run=["run"], shifts=AMBIGUITY + 1).select("run", "best", "margin_z", "critical_z", F.col("shift").alias("selected"))
    return pooled.join(chosen, "run")
