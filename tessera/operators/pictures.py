"""Series of pictures: is one picture held under noise, and are captures torn between neighbouring frames?

A picture is an array of numbers, row by row, of one size within a key. Neighbours are found over ranges of a key, so a key may
be any share of the rows; only sums of a picture or of a pixel leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.windows import before, dealt, running
from tessera.session import kept

SIGMA = 3.0
#: bands of rows in which tears are sought, as shares of a picture's height
BANDS = ((0.0, 1 / 3), (1 / 3, 2 / 3))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def held(frames: DataFrame, *, key: list[str], sigma: float = SIGMA) -> DataFrame:
    """Per key: frames, distinct (without exact repeats of the frame before), motion and still.

    frames has key, frame (distinct numbers) and picture; null pictures are no frames. Differences of neighbouring frames share
    one frame's noise with opposite signs, so under noise alone they correlate at -1/2 (motion is their mean); a picture that
    is held also varies more over its pixels than its noise averaged over the frames. Fewer than four distinct frames are
    still, with motion null; pictures of one number, which share nothing over pixels, are not.
    """
    rows = frames.where("picture is not null").select(*key, F.col("frame").cast("long").alias("frame"), "picture")
    # any cuts are right, so rows are dealt once and keep their range
    ranged = kept(dealt(rows, key=key, by="frame"))
    near = dict(key=key, order=["frame"])
    count = ranged.groupBy(*key).agg(F.count("*").alias("frames"))
    told = before(ranged, value="picture", name="_was", **near)
    told = kept(told.where(~F.col("_was").eqNullSafe(F.col("picture"))).drop("_was"))
    steps = before(told, value="picture", name="_was", **near).where("_was is not null")
    steps = kept(steps.select(*key, "_range", "frame", F.zip_with("picture", "_was", lambda a, b: a - b).alias("step")))
    both = before(steps, value="step", name="_last", **near).where("_last is not null")
    turn = _dot("step", "_last") / F.sqrt(_dot("step", "step") * _dot("_last", "_last"))
    turns = both.select(*key, turn.alias("_c")).groupBy(*key).agg(F.avg("_c").alias("_motion"), F.stddev_samp("_c").alias("_spread"), F.count("*").alias("_turns"))
    pixel = told.select(*key, F.posexplode("picture").alias("_i", "_x")).groupBy(*key, "_i").agg(F.avg("_x").alias("_m"), (F.var_pop("_x") * F.count("*")).alias("_w"), F.count("*").alias("_n"))
    level = pixel.groupBy(*key).agg(F.max("_n").alias("distinct"), F.count("*").alias("_pixels"), F.sum("_w").alias("_within"), F.var_samp("_m").alias("_between"))
    found = count.join(level, key).join(turns, key, "left")
    n, pixels = F.col("distinct"), F.col("_pixels")
    noise = F.abs(F.col("_motion") + 0.5) <= sigma * F.col("_spread") / F.sqrt("_turns")
    ratio = F.try_divide(n * F.col("_between") * pixels * (n - 1), F.col("_within"))
    shared = ratio > 1 + sigma * F.sqrt(F.try_divide(F.lit(2), pixels - 1) + F.try_divide(F.lit(2), pixels * (n - 1)))
    few = n < 4
    return found.select(*key, "frames", "distinct", F.when(~few, F.col("_motion")).alias("motion"), F.when(few, True).otherwise(F.coalesce(noise & shared, F.lit(False))).alias("still"))


def band_error(a: Column, b: Column, first: int, last: int) -> Column:
    """Mean absolute difference of two pictures over the pixels from first up to last."""
    part = lambda p: F.slice(p, first + 1, last - first)
    return F.aggregate(F.zip_with(part(a), part(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / (last - first)


def tears(frames: DataFrame, *, key: list[str], width: int, height: int, bands=BANDS, every: int = 7) -> DataFrame:
    """Per key with three frames or more: gain, offset, judged and torn.

    frames has key, frame, captured and source, pictures of width * height. Frames with one on either side are looked at. The
    source is brought to the captures' levels by a line through every seventh pixel of those frames (gain 0 and the captures'
    mean where the source is flat). A band is judged where its neighbouring source frames differ from it by more than the
    better match's residual, and torn where one of them matches the capture better.
    """
    rows = frames.select(*key, F.col("frame").cast("long").alias("frame"), F.col("captured").cast("array<double>").alias("captured"), F.col("source").cast("array<double>").alias("source")).withColumn("_one", F.lit(1))
    ranged = kept(dealt(rows, key=key, by="frame"))
    near = dict(key=key, order=["frame"])
    placed = running(ranged, sums={"_place": "_one"}, **near)
    one = before(placed, value="source", name="_back", **near).withColumn("_now", F.struct("captured", "source", F.col("_back").alias("back"), F.col("_place").alias("place")))
    both = before(one, value="_now", name="_mid", **near).where("_mid.back is not null")
    size = width * height
    triple = kept(both.select(*key, (F.col("_mid.place") - 2).alias("_at"), *[F.col(f"_mid.{c}").alias(c) for c in ("captured", "source", "back")], F.col("source").alias("next")))
    pairs = F.arrays_zip(F.sequence(F.lit(0), F.lit(size - 1)).alias("i"), F.col("source").alias("x"), F.col("captured").alias("y"))
    taken = F.filter(pairs, lambda p: (F.col("_at") * size + p["i"]) % every == 0)
    total = lambda of: F.aggregate(F.transform(taken, of), F.lit(0.0), lambda s, v: s + v)
    sums = triple.select(*key, F.size(taken).alias("n"), total(lambda p: p["x"]).alias("x"), total(lambda p: p["y"]).alias("y"), total(lambda p: p["x"] * p["x"]).alias("xx"), total(lambda p: p["x"] * p["y"]).alias("xy")).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "xy")])
    gain = F.coalesce(F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.col("n") * F.col("xx") - F.col("x") * F.col("x")), F.lit(0.0))
    line = sums.select(*key, gain.alias("gain"), ((F.col("y") - gain * F.col("x")) / F.col("n")).alias("offset"))
    fitted = triple.join(line, key)
    level = lambda c: F.transform(c, lambda x: F.col("gain") * x + F.col("offset"))
    fitted = fitted.select(*key, "gain", "offset", "captured", *[level(c).alias(c) for c in ("source", "back", "next")])
    cells = []
    for top, bottom in bands:
        at = [round(share * height) * width for share in (top, bottom)]
        error = lambda a, b: band_error(F.col(a), F.col(b), *at)  # noqa: B023, E731
        cells.append(F.struct(error("captured", "source").alias("own"), F.least(error("captured", "back"), error("captured", "next")).alias("near"), F.least(error("source", "back"), error("source", "next")).alias("apart")))
    bands_ = fitted.select(*key, "gain", "offset", F.explode(F.array(*cells)).alias("b"))
    seen = F.col("b.apart") > F.least("b.own", "b.near")
    return bands_.groupBy(*key, "gain", "offset").agg(F.count_if(seen).alias("judged"), F.count_if(seen & (F.col("b.near") < F.col("b.own"))).alias("torn"))


def restaggered(plan: DataFrame, *, key: list[str], owner: str, order: str) -> DataFrame:
    """plan with the writes of each owner after target 0 spread one a target from where they start, in the order of a number."""
    later = plan.where("target > 0").withColumn("_one", F.lit(1))
    owned = [*key, owner]
    ranged = kept(dealt(later, key=owned, by=order))
    first = ranged.groupBy(*owned).agg(F.min("target").alias("_first"))
    spread = running(ranged, key=owned, order=[order], sums={"_place": "_one"}, peers=False).join(first, owned).withColumn("target", F.col("_first") + F.col("_place") - 1)
    return spread.select(*plan.columns).unionByName(plan.where("target <= 0 or target is null"))
