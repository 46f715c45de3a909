"""Array metrics over embeddings as small frames, and over users' value series; streaming queries over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import arrays
from tessera.functions.exprs import band_distance, saturate
from tessera.plans.catalogue import register
from tessera.plans.sequences import LIMITER_SQL
from tessera.plans.tables import events, r6, table
from tessera.session import shared_path
from tessera.streaming import processors

_PAIRS = "WITH f AS (SELECT vec_id, cast(embedding AS DOUBLE[]) AS x, label FROM embeddings), p AS (SELECT vec_id, x, lag(x) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM f), u AS (SELECT vec_id, unnest(x) AS x, unnest(b) AS b FROM p WHERE b IS NOT NULL)"


def frame_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive embeddings of a label: x and the one before, b."""
    before = F.lag("x").over(Window.partitionBy("label").orderBy("vec_id"))
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return e.withColumn("b", before).where("b is not null").select("vec_id", "x", "b")


@register(_PAIRS + " SELECT vec_id, round(sqrt(avg((x - b) ** 2)), 6) AS rms, round(avg(abs(x - b)), 6) AS change FROM u GROUP BY 1")
def frame_distance(spark: SparkSession, d: str) -> DataFrame:
    """RMS and mean absolute change between consecutive frames."""
    diff = F.transform(F.arrays_zip("x", "b"), lambda z: z["x"] - z["b"])
    p = frame_pairs(spark, d).select("vec_id", diff.alias("d"))
    mean = lambda f: F.aggregate("d", F.lit(0.0), lambda a, z: a + f(z)) / F.size("d")
    return p.select("vec_id", r6(F.sqrt(mean(lambda z: z * z))).alias("rms"), r6(mean(F.abs)).alias("change"))


@register(_PAIRS + " SELECT vec_id, round(CASE WHEN avg((x - b) ** 2) < 1e-10 THEN 0 ELSE avg(x - b) ** 2 / avg((x - b) ** 2) END, 6) AS level, round(CASE WHEN avg((x - b) ** 2) < 1e-10 THEN 0 ELSE 1 - avg(x - b) ** 2 / avg((x - b) ** 2) END, 6) AS structure FROM u GROUP BY 1")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    """Level and structure shares of each frame change."""
    p = frame_pairs(spark, d).select("vec_id", F.transform(F.arrays_zip("x", "b"), lambda z: z["x"] - z["b"]).alias("d"))
    mean = lambda f: F.aggregate("d", F.lit(0.0), lambda a, z: a + f(z)) / F.size("d")
    m = p.select("vec_id", mean(lambda z: z).alias("level"), mean(lambda z: z * z).alias("total"))
    share = F.col("level") * F.col("level") / F.col("total")
    quiet = F.col("total") < 1e-10
    return m.select("vec_id", r6(F.when(quiet, 0.0).otherwise(share)).alias("level"), r6(F.when(quiet, 0.0).otherwise(1 - share)).alias("structure"))


@register("""
WITH v AS (SELECT label, unnest(cast(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x) / any_value(p.n * q.n), 6) AS similarity FROM m a JOIN m b ON a.i = b.i AND a.label < b.label JOIN n p ON p.label = a.label JOIN n q ON q.label = b.label GROUP BY 1, 2
""")
def cosine_ssm(spark: SparkSession, d: str) -> DataFrame:
    """Cosine similarity of label means; labels are few, rows are summed before they meet."""
    v = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = v.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("x"))
    a, b = rows.select(F.col("label").alias("a"), F.col("x").alias("u")), rows.select(F.col("label").alias("b"), F.col("x").alias("v"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda c, z: c + z)
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", r6(dot("u", "v") / F.sqrt(dot("u", "u")) / F.sqrt(dot("v", "v"))).alias("similarity"))


@register()
def frame_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Spectrum, oriented energy and spatial information of each 8x8 frame."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    s = arrays.array_metric(arrays.radial_spectrum, ["slope", "r2", "dimension"])
    g = arrays.array_metric(arrays.gabor_energy, ["peak", "concentration"])
    return e.select("vec_id", s(F.col("x")).alias("s"), g(F.col("x")).alias("g")).select("vec_id", "s.*", "g.*")


@register()
def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Structural similarity and information of consecutive frames."""
    p, x, b = frame_pairs(spark, d), F.col("x"), F.col("b")
    m, i = arrays.array_metric(arrays.ssim, ["ssim"]), arrays.array_metric(arrays.information, ["si", "ti"])
    return p.select("vec_id", m(x, b).alias("m"), i(x, b).alias("i")).select("vec_id", "m.ssim", "i.si", "i.ti")


@register()
def series_dynamics(spark: SparkSession, d: str) -> DataFrame:
    """Dynamics class, period, strength and winding number of each user's hourly value series."""
    hour = events(spark, d).groupBy("user_id", F.floor(F.col("t") / 3_600_000_000).alias("h")).agg(F.avg("value").alias("v"))
    rows = hour.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "v"))), lambda z: z["v"]).alias("x"))
    return rows.select("user_id", arrays.series_regimes(F.col("x")).alias("m")).select("user_id", "m.*")


#: fixed values: term of a clip's score, its descriptor, its weight (negative for a penalty), how the descriptor becomes a
#: share of 1, and the band it should lie in
SCORE_TERMS = [
    ("mud", "concentration", -1.0, "share", None),
    ("spectrum", "slope", -1.0, "outside", (-1.4, -1.0)),
    ("fractal", "dimension", 1.0, "inside", (1.3, 1.5)),
    ("legality", "clip", -1.0, "share", None),
    ("motion", "motion", 0.5, "much", None),
    ("surprisal", "surprisal", 1.0, "much", None),
    ("boredom", "luma_std", -0.5, "little", None),
]


def score_term(descriptor: str, shape: str, band: tuple[float, float] | None) -> Column:
    """A descriptor as a share of 1."""
    x = F.col(descriptor)
    if shape == "share":
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    size = saturate(band_distance(x, *band) if band else x)
    return 1 - size if shape in ("inside", "little") else size


def clip_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Per label, as a clip of frames in order of id: means of the frame metrics, of motion, and surprisal of the changes.

    Surprisal is that of each change's tenth of the label's range after the tenth before, by the label's own counts.
    """
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    s, g = arrays.array_metric(arrays.radial_spectrum, ["slope", "dimension"]), arrays.array_metric(arrays.gabor_energy, ["concentration"])
    total = lambda f: F.aggregate("x", F.lit(0.0), lambda a, v: a + f(v)) / F.size("x")
    mean = total(lambda v: v)
    clipped = total(lambda v: F.when((v <= -0.3) | (v >= 0.3), 1.0).otherwise(0.0))
    w = Window.partitionBy("label").orderBy("vec_id")
    frames = e.select("vec_id", "label", s(F.col("x")).alias("s"), g(F.col("x")).alias("g"), F.sqrt(total(lambda v: v * v) - mean * mean).alias("luma_std"), clipped.alias("clip"), "x", F.lag("x").over(w).alias("b"))
    change = F.aggregate(F.zip_with("x", "b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda a, v: a + v) / F.size("x")
    frames = frames.select("vec_id", "label", "s.*", "g.*", "luma_std", "clip", change.alias("change"))
    own = frames.groupBy("label").agg(F.count("*").alias("frames"), F.avg("slope").alias("slope"), F.avg("dimension").alias("dimension"), F.avg("concentration").alias("concentration"), F.avg("luma_std").alias("luma_std"), F.avg("clip").alias("clip"), F.avg("change").alias("motion"), F.min("change").alias("_low"), F.max("change").alias("_high"))
    symbol = F.least(F.lit(9), F.floor((F.col("change") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * 10))
    steps = frames.where("change is not null").join(own.select("label", "_low", "_high"), "label").select("label", "vec_id", F.coalesce(symbol, F.lit(0)).alias("a"))
    steps = steps.select("label", F.lag("a").over(w).alias("before"), "a").where("before is not null").groupBy("label", "before", "a").agg(F.count("*").alias("n"))
    all_of = F.sum("n").over(Window.partitionBy("label", "before"))
    bits = steps.withColumn("bits", -F.col("n") * F.log2(F.col("n") / all_of)).groupBy("label").agg((F.sum("bits") / F.sum("n")).alias("surprisal"))
    return own.drop("_low", "_high").join(bits, "label", "left")


@register()
def clip_scores(spark: SparkSession, d: str) -> DataFrame:
    """Descriptor and weighted score in [-1, 1] of each label's clip: rewards less penalties over the sum of the weights."""
    score, weights = F.lit(0.0), 0.0
    for _, descriptor, weight, shape, band in SCORE_TERMS:
        score += weight * score_term(descriptor, shape, band)
        weights += abs(weight)
    return clip_descriptors(spark, d).withColumn("score", r6(score / weights))


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return processors.event_stream(spark, f"{d}/events*.parquet", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def _checkpoint(spark: SparkSession) -> str:
    return shared_path(spark, "stream")


@register("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts from the event stream, complete output over what is there."""
    w = processors.tumbling(_stream(spark, d), time="ts", width="1 hour", late="2 hours", keys=["event_type"], value="value")
    made = processors.drain_complete(w, _checkpoint(spark))
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("""
WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS n FROM events)
SELECT cast(user_id AS VARCHAR) AS key, event_id AS id, event_type AS value FROM m WHERE n = 1
""")
def stream_run_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Run-length dedup of each user's event types with streaming state."""
    s = _stream(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.unix_micros("ts").alias("t"), F.col("event_type").alias("value"))
    return processors.drain(processors.run_dedup(s), "dedup", _checkpoint(spark)).select("key", "id", "value")


@register("WITH RECURSIVE" + LIMITER_SQL.split("WITH RECURSIVE", 1)[1].replace("SELECT user_id, s1 AS at, v1 AS value FROM f", "SELECT cast(user_id AS VARCHAR) AS key, s1 AS at, v1 AS value FROM f").replace("SELECT user_id, s0, v0 FROM f", "SELECT cast(user_id AS VARCHAR), s0, v0 FROM f").replace("SELECT f.user_id, f.due, f.wait FROM f", "SELECT cast(f.user_id AS VARCHAR), f.due, f.wait FROM f"))
def stream_limiter(spark: SparkSession, d: str) -> DataFrame:
    """Rate limiter on the event stream with event-time timers.

    When the events are drained, a closing row a day and a gap after the last one moves the watermark on, so that the timers
    of all waiting writes fire.
    """
    gap, end = 43_200_000_000, _checkpoint(spark)
    shape = lambda s: s.select(F.col("user_id").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("t"), "value")
    empty = spark.createDataFrame([], EVENTS)
    empty.write.parquet(f"{end}/closing")
    closing = processors.event_stream(spark, f"{end}/closing", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = shape(_stream(spark, d)).unionByName(shape(closing).withColumn("key", F.lit(None).cast("string")))
    limited = processors.limiter(rows, gap=gap, late="1 hour")
    processors.drain(limited, "limiter", end)
    last = table(spark, d, "events").agg(F.max("ts").alias("ts")).select(F.lit(0).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 36 hours")).alias("ts"), F.lit(None).cast("long").alias("user_id"), F.lit("").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
    last.write.mode("append").parquet(f"{end}/closing")
    return processors.drain(limited, "limiter", end).where("key is not null")


@register("SELECT event_id FROM events")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Each event once, however often it is delivered."""
    s = _stream(spark, d)
    return processors.drain(processors.first_seen(s.unionByName(s), time="ts", late="40 days", keys=["event_id"]).select("event_id"), "first", _checkpoint(spark))
