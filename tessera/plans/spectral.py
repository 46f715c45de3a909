"""Spectrograms and band envelopes of users' hourly totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import spectra
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6

HOUR = 3_600_000_000
#: cycles a day
BANDS = [(0.2, 0.8), (0.8, 2.0), (2.0, 5.0), (5.0, 11.0)]


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """user_id, place (hours since the user's first), n (hours in all) and y, the hour's total, 0 where there is none."""
    h = events(spark, d).groupBy("user_id", F.floor(F.col("t") / HOUR).alias("h")).agg(F.sum("value").alias("y"))
    ends = h.groupBy("user_id").agg(F.min("h").alias("a"), F.max("h").alias("z"))
    grid = ends.select("user_id", "a", (F.col("z") - F.col("a") + 1).alias("n"), F.explode(F.sequence("a", "z")).alias("h"))
    return grid.join(h, ["user_id", "h"], "left").select("user_id", (F.col("h") - F.col("a")).alias("place"), "n", F.coalesce("y", F.lit(0.0)).alias("y"))


@register("""
WITH h AS (SELECT user_id, epoch_us(ts) // 3600000000 AS h, sum(value) AS y FROM events GROUP BY 1, 2), a AS (SELECT user_id, min(h) AS a, max(h) - min(h) + 1 AS n FROM h GROUP BY 1),
p AS (SELECT user_id, n, h - a AS i, y FROM h JOIN a USING (user_id)), f AS (SELECT user_id, unnest(range(greatest(1, (n - 64) // 16 + 1))) AS frame FROM a),
k AS (SELECT unnest(range(1, 33)) AS k), b AS (SELECT k, CASE WHEN k < 2 THEN 0 WHEN k < 3 THEN 1 WHEN k < 4 THEN 2 WHEN k < 7 THEN 3 WHEN k < 12 THEN 4 WHEN k < 20 THEN 5 ELSE 6 END AS band FROM k),
w AS (SELECT f.user_id, frame, i - frame * 16 AS j, y * (0.5 - 0.5 * cos(2 * pi() * (i - frame * 16) / 63)) AS y FROM f JOIN p ON p.user_id = f.user_id AND i >= frame * 16 AND i < frame * 16 + 64),
s AS (SELECT user_id, frame, k, sqrt(pow(sum(y * cos(2 * pi() * k * j / 64)), 2) + pow(sum(y * sin(2 * pi() * k * j / 64)), 2)) AS m FROM w CROSS JOIN k GROUP BY 1, 2, 3)
SELECT f.user_id, f.frame, cast(b.band AS INTEGER) AS band, round(ln(1 + sum(coalesce(m, 0))), 6) AS level FROM f CROSS JOIN b LEFT JOIN s ON s.user_id = f.user_id AND s.frame = f.frame AND s.k = b.k GROUP BY 1, 2, 3
""")
def hourly_spectrogram(spark: SparkSession, d: str) -> DataFrame:
    """Band levels of users' hourly totals in windows of 64 hours, 16 apart."""
    made = spectra.band_spectrogram(hourly(spark, d), key="user_id", place="place", value="y", size="n", n_fft=64, hop=16, bands=7)
    return made.select("user_id", "frame", F.posexplode("bands").alias("band", "level")).withColumn("level", r6("level"))


@register()
def hourly_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes of four bands of users' hourly totals."""
    made = spectra.band_envelopes(hourly(spark, d), key="user_id", place="place", value="y", rate=24.0, bands=BANDS, smooth=0.5)
    return made.withColumn("envelope", r6("envelope"))
