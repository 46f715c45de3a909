"""Sections of vector series: checkerboard novelty, its prominent peaks, and sections named by likeness; phrases on a grid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.operators.windows import dealt, running
from tessera.session import kept


def checkerboard(half: int) -> np.ndarray:
    """One side of the checkerboard kernel: a signed Gaussian over two deviations either way. The kernel is its outer product."""
    x = np.linspace(-2.0, 2.0, 2 * half + 1)
    return np.sign(x) * np.exp(-0.5 * x * x)


def novelty(series: DataFrame, *, key: str, place: str, vector: str, size: str, kernel: int, chunk: int = 2048) -> DataFrame:
    """key, place and raw novelty of each vector of a series: the kernel laid over the cosine similarities about it.

    As the kernel is an outer product and similarities are products of unit vectors, the sum over the square is the squared
    length of one weighted sum of neighbours; places before the first or after the last count as that. A vector goes to the
    chunks within half a kernel of it, so the work is linear and a series is many tasks. place counts from 0, size is the
    series' length.
    """
    half = F.greatest(F.lit(1), F.least(F.lit(kernel // 2), F.floor(F.col(size) / 2))).cast("int")
    rows = series.select(F.col(key).alias("_key"), F.col(place).cast("long").alias("_p"), F.col(vector).cast("array<double>").alias("_x"), F.col(size).cast("long").alias("_n"), half.alias("_h"))
    near = F.sequence(F.floor(F.greatest(F.lit(0), F.col("_p") - F.col("_h")) / chunk), F.floor(F.least(F.col("_n") - 1, F.col("_p") + F.col("_h")) / chunk))
    kind = dict(rows.dtypes)["_key"]

    def score(table: pa.Table) -> pa.Table:
        p, h, n = (table.column(c).to_numpy() for c in ("_p", "_h", "_n"))
        order = np.argsort(p)
        x = np.array(table.column("_x").to_pylist())[order]
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
        p, half, n = p[order], int(h[0]), int(n[0])
        first = int(table.column("_chunk")[0].as_py()) * chunk
        own = np.arange(first, min(first + chunk, n))
        total = np.zeros((len(own), x.shape[1]))
        for off, w in zip(range(-half, half + 1), checkerboard(half)):
            if w:
                total += w * x[np.clip(own + off, 0, n - 1) - p[0]]
        keys = table.column("_key").combine_chunks()
        return pa.table([keys.take(pa.array(np.zeros(len(own), np.int64))), pa.array(own), pa.array((total**2).sum(1))], names=["key", "place", "novelty"])

    dealt_rows = rows.withColumn("_chunk", F.explode(near))
    return dealt_rows.groupBy("_key", "_chunk").applyInArrow(score, f"key {kind}, place long, novelty double")


def local_peaks(x: np.ndarray) -> np.ndarray:
    """Places of the maxima of a series, the middle of flat ones, without its ends."""
    edge = np.flatnonzero(np.append(True, np.diff(x) != 0))  # starts of level stretches
    last = np.append(edge[1:], len(x)) - 1
    level = x[edge]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (edge[top] + last[top]) // 2


def spaced(x: np.ndarray, peaks: np.ndarray, distance: int) -> np.ndarray:
    """Peaks that remain when each, from the highest down (of equal ones the later first), removes those nearer than distance."""
    keep = np.ones(len(peaks), bool)
    for i in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[i]:
            a, b = np.searchsorted(peaks, [peaks[i] - distance + 1, peaks[i] + distance])
            keep[a:b] = False
            keep[i] = True
    return peaks[keep]


def prominence(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the two lowest points between it and the nearest higher place on either side (or
    the series' end). One pass a side over a falling stack of (height, lowest point since the one below it)."""
    sides = []
    for series, at in ((x, peaks), (x[::-1], len(x) - 1 - peaks)):
        floor = np.empty(len(x))
        stack: list[tuple[float, float]] = []
        for i, v in enumerate(series.tolist()):
            low = v
            while stack and stack[-1][0] <= v:
                low = min(low, stack.pop()[1])
            floor[i] = low
            stack.append((v, low))
        sides.append(floor[at])
    return x[peaks] - np.maximum(*sides)


def boundaries(x: np.ndarray, distance: int, sigma: float) -> np.ndarray:
    """Section starts in a raw novelty series: its peaks with enough distance and prominence after scaling to [0, 1]."""
    if len(x) < 4:
        return np.array([0])
    x = x - x.min()
    x = x / (x.max() + 1e-9)
    peaks = spaced(x, local_peaks(x), distance)
    peaks = peaks[prominence(x, peaks) >= sigma * x.std()]
    return np.unique(np.append(0, peaks))


def classes(means: np.ndarray) -> np.ndarray:
    """Class of each section, from 0: that of the most like earlier one if it is more like than the median of all pairs, else a
    new one."""
    unit = means / (np.linalg.norm(means, axis=1, keepdims=True) + 1e-9)
    like = unit @ unit.T
    off = like[~np.eye(len(like), dtype=bool)]
    bound = np.median(off) if len(off) else 1.0
    out = np.zeros(len(means), np.int64)
    for k in range(1, len(means)):
        j = int(like[k, :k].argmax())
        out[k] = out[j] if like[k, j] > bound else out[:k].max() + 1
    return out


def sections(series: DataFrame, *, key: str, order: str, vector: str, kernel: int = 16, distance: int = 6, sigma: float = 1.0) -> DataFrame:
    """Sections of each key's series of vectors: key, section (from 0), start, end (places, end excluded) and class.

    The order column is a number without repeats in a key. Vectors are dealt by ranges; only a series' novelty (one number a
    vector) and its sections' mean vectors come together in one row.
    """
    rows = series.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("_o"), F.col(vector).alias("x"), F.lit(1).alias("_one"))
    size = rows.groupBy("key").agg(F.count("*").alias("n"))
    placed = running(dealt(rows, key=["key"], by="_o"), key=["key"], order=["_o"], sums={"_k": "_one"}).join(size, "key")
    placed = kept(placed.select("key", "x", "n", (F.col("_k") - 1).alias("place")))
    raw = novelty(placed, key="key", place="place", vector="x", size="n", kernel=kernel)
    starts = raw.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "novelty"))), lambda z: z["novelty"]).alias("v")).select("key", _starts(F.col("v"), distance, sigma).alias("s"))
    ends = starts.join(size, "key").select("key", F.posexplode("s").alias("section", "start"), "s", "n")
    cut = kept(ends.select("key", "section", "start", F.coalesce(F.get("s", F.col("section") + 1), F.col("n")).alias("end")))
    mark = cut.select("key", F.col("start").alias("place"), F.lit(1).alias("m"))
    within = running(dealt(placed.join(mark, ["key", "place"], "left").withColumn("m", F.coalesce("m", F.lit(0))), key=["key"], by="place"), key=["key"], order=["place"], sums={"section": "m"})
    mean = within.select("key", (F.col("section") - 1).alias("section"), F.posexplode(F.col("x").cast("array<double>")).alias("i", "v")).groupBy("key", "section", "i").agg(F.avg("v").alias("v"))
    whole = mean.groupBy("key", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda z: z["v"]).alias("x"))
    named = whole.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "x"))), lambda z: z["x"]).alias("m")).select("key", F.posexplode(_classes(F.col("m"))).alias("section", "class"))
    return cut.join(named, ["key", "section"]).select(F.col("key").alias(key), "section", "start", "end", "class")


def _starts(series: Column, distance: int, sigma: float) -> Column:
    @F.arrow_udf("array<bigint>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([boundaries(np.array(x), distance, sigma).tolist() for x in column.to_pylist()], pa.list_(pa.int64()))

    return run(series)


def _classes(means: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([classes(np.array(x)).tolist() for x in column.to_pylist()], pa.list_(pa.int64()))

    return run(means)


def phrases(spans: DataFrame, marks: DataFrame, *, key: list[str], start: str, end: str, at: str, width: int) -> DataFrame:
    """Spans split at the marks strictly inside them: each row of spans once a piece, with `piece` (from 0), start and end.

    Marks meet spans in buckets of `width`; pieces are rebuilt from the start of the next.
    """
    named = spans.withColumn("_span", F.struct("*"))
    inner = joins.interval_join(marks.select(*key, F.col(at).alias("_at")).distinct(), named.select(*key, start, end, "_span"), time="_at", start=start, end=end, width=width, key=key)
    cuts = inner.where((F.col("_at") > F.col(start)) & (F.col("_at") < F.col(end))).select("_span", F.col("_at").alias("_from"))
    edges = named.select("_span", F.col(start).alias("_from")).distinct().unionByName(cuts)
    w = Window.partitionBy("_span").orderBy("_from")
    pieces = edges.select("_span", "_from", F.coalesce(F.lead("_from").over(w), F.col(f"_span.{end}")).alias("_to"), (F.row_number().over(w) - 1).alias("piece"))
    return pieces.select(*[F.col(f"_span.{c}").alias(c) for c in spans.columns if c not in (start, end)], "piece", F.col("_from").alias(start), F.col("_to").alias(end))
