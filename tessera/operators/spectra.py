"""Band spectrograms and band envelopes of long series: windows and recursive filters dealt by ranges of a series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import kept


def band_edges(n_fft: int, bands: int) -> np.ndarray:
    """First spectrum bins of geometrically spaced bands, without repeats; the last entry ends none, as the last band runs on."""
    return np.unique(np.rint(np.geomspace(1, n_fft // 2, bands + 1)).astype(int))[:-1]


def band_spectrogram(series: DataFrame, *, key: str, place: str, value: str, size: str, n_fft: int, hop: int, bands: int, chunk: int = 64) -> DataFrame:
    """key, frame and bands: logarithms of one plus the magnitude in each band, under a Hann window.

    place counts from 0 without gaps, size is the series' length (a column). Samples go in one pass to the groups of `chunk`
    frames that hold them, so they are copied only where groups meet and a series is many tasks. A series shorter than a window
    is filled with zeros to one frame; frames that run over the end are not made.
    """
    rows = series.select(F.col(key).alias("key"), F.col(place).cast("long").alias("_p"), F.col(value).cast("double").alias("_y"), F.col(size).cast("long").alias("_n"))
    count = F.greatest(F.lit(1).cast("long"), F.floor((F.col("_n") - n_fft) / hop) + 1)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_p") - n_fft + 1) / hop))
    last = F.least(F.floor(F.col("_p") / hop), count - 1)
    sent = rows.withColumn("_count", count).where(first <= last).withColumn("_chunk", F.explode(F.sequence(F.floor(first / chunk), F.floor(last / chunk))))
    edges, window = band_edges(n_fft, bands), np.hanning(n_fft)
    kind = dict(rows.dtypes)["key"]

    def frames(table: pa.Table) -> pa.Table:
        p, y = table.column("_p").to_numpy(), table.column("_y").to_numpy(zero_copy_only=False)
        own = int(table.column("_chunk")[0].as_py()) * chunk
        number = np.arange(own, min(own + chunk, int(table.column("_count")[0].as_py())))
        line = np.zeros((len(number) - 1) * hop + n_fft)
        line[p - own * hop] = np.nan_to_num(y)
        cut = np.lib.stride_tricks.sliding_window_view(line, n_fft)[::hop]
        size = np.abs(np.fft.rfft(cut * window, axis=1))
        made = np.log1p(np.add.reduceat(size, edges, axis=1))
        keys = table.column("key").combine_chunks().take(pa.array(np.zeros(len(number), np.int64)))
        return pa.table([keys, pa.array(number), pa.array(made.tolist(), pa.list_(pa.float64()))], names=["key", "frame", "bands"])

    made = sent.groupBy("key", "_chunk").applyInArrow(frames, f"key {kind}, frame long, bands array<double>")
    return made.withColumnRenamed("key", key)


def butterworth(order: int, cut: float | tuple[float, float], rate: float) -> np.ndarray:
    """Digital Butterworth filter, low-pass below a frequency or band-pass between two, as biquads (b0, b1, b2, a1, a2).

    Analogue poles on the circle, moved to the band, then the bilinear transform with its frequencies corrected. Orders are even.
    """
    turn = np.exp(1j * np.pi * (2 * np.arange(order // 2) + order + 1) / (2 * order))  # one of each conjugate pair
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    if isinstance(cut, tuple):
        low, high = warp(cut[0]), warp(cut[1])
        half = turn * (high - low) / 2
        root = np.sqrt(half * half - low * high)
        poles, gain, top = np.concatenate([half + root, half - root]), high - low, (1.0, 0.0, -1.0)
        level = (2 * rate * gain) ** order
    else:
        poles, top = turn * warp(cut), (1.0, 2.0, 1.0)
        level = warp(cut) ** order
    level = (level / np.prod(np.abs(2 * rate - poles) ** 2)) ** (1 / len(poles))  # an equal share of the gain each
    z = (2 * rate + poles) / (2 * rate - poles)
    return np.array([[*(level * t for t in top), -2 * p.real, abs(p) ** 2] for p in z])


class Filter:
    """A cascade of biquads as one linear state: state' = a state + b u, y = c state + d u; runs of samples as blocks."""

    BLOCK = 128

    def __init__(self, biquads: np.ndarray):
        a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
        for b0, b1, b2, a1, a2 in biquads:
            own, put, get = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0])
            n = len(b)
            a = np.block([[a, np.zeros((n, 2))], [np.outer(put, c), own]])
            b, c, d = np.concatenate([b, put * d]), np.concatenate([b0 * c, get]), b0 * d
        self.a, self.b, self.c, self.d = a, b, c, d
        power = [np.eye(len(b))]
        for _ in range(self.BLOCK):
            power.append(a @ power[-1])
        self.power = np.array(power)
        self.seen = self.power[:-1] @ b  # what an input leaves in the state so many steps later
        answer = np.concatenate([[d], self.seen[:-1] @ c])
        lag = np.subtract.outer(np.arange(self.BLOCK), np.arange(self.BLOCK))
        self.answer = np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0)
        self.view = np.einsum("k,nkj->nj", c, self.power[:-1])

    def run(self, u: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and the state after the samples."""
        out = np.empty(len(u))
        for i in range(0, len(u), self.BLOCK):
            x = u[i : i + self.BLOCK]
            m = len(x)
            out[i : i + m] = self.answer[:m, :m] @ x + self.view[:m] @ state
            state = self.power[m] @ state + self.seen[m - 1 :: -1].T[:, :m] @ x
        return out, state

    def over(self, steps: int) -> np.ndarray:
        """Map of the state over so many steps without input."""
        return np.linalg.matrix_power(self.a, steps)


def _carried(ends: DataFrame, filters: list[Filter]) -> DataFrame:
    """key, chunk and the states (of all filters) each chunk begins with, from what every chunk leaves of a state of zero.

    A chunk is an affine map of states; a key's maps are applied in order. One row of a few numbers a chunk comes together.
    """

    @F.arrow_udf("array<array<double>>")
    def run(sizes: pa.Array, left: pa.Array) -> pa.Array:
        out = []
        for lengths, own in zip(sizes.to_pylist(), left.to_pylist()):
            states, made, maps = [np.zeros(len(f.b)) for f in filters], [], {}
            for n, flat in zip(lengths, own):
                made.append(np.concatenate(states).tolist())
                if n not in maps:
                    maps[n] = [f.over(n) for f in filters]
                at = np.split(np.array(flat), np.cumsum([len(f.b) for f in filters])[:-1])
                states = [m @ s + e for m, s, e in zip(maps[n], states, at)]
            out.append(made)
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    rows = ends.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "n", "left"))).alias("z"))
    return rows.select("key", F.explode(F.arrays_zip(F.col("z.chunk").alias("chunk"), run(F.col("z.n"), F.col("z.left")).alias("state"))).alias("s")).select("key", "s.*")


def _filtered(y: Column, first: list[Filter], second: list[Filter], state: Column | None, later: Column | None) -> Column:
    """Per chunk: the states the bands leave, or, with states to begin with, those the smoothers leave, or the envelopes."""
    sizes = np.cumsum([len(f.b) for f in first])[:-1]
    after = np.cumsum([len(f.b) for f in second])[:-1]

    def work(values, begin, smooth):
        x = np.array(values)
        if begin is None:
            return np.concatenate([f.run(x, np.zeros(len(f.b)))[1] for f in first]).tolist()
        level = [np.abs(f.run(x, s)[0]) for f, s in zip(first, np.split(np.array(begin), sizes))]
        if smooth is None:
            return np.concatenate([f.run(v, np.zeros(len(f.b)))[1] for f, v in zip(second, level)]).tolist()
        return [f.run(v, s)[0].tolist() for f, v, s in zip(second, level, np.split(np.array(smooth), after))]

    kind, given = ("array<array<double>>", [y, state, later]) if later is not None else ("array<double>", [y] if state is None else [y, state])
    typed = pa.list_(pa.list_(pa.float64())) if later is not None else pa.list_(pa.float64())
    if len(given) == 3:
        return F.arrow_udf(lambda a, b, c: pa.array([work(*r) for r in zip(a.to_pylist(), b.to_pylist(), c.to_pylist())], typed), kind)(*given)
    if len(given) == 2:
        return F.arrow_udf(lambda a, b: pa.array([work(*r, None) for r in zip(a.to_pylist(), b.to_pylist())], typed), kind)(*given)
    return F.arrow_udf(lambda a: pa.array([work(r, None, None) for r in a.to_pylist()], typed), kind)(*given)


def band_envelopes(series: DataFrame, *, key: str, place: str, value: str, rate: float, bands: list[tuple[float, float]], smooth: float, chunk: int = 8192) -> DataFrame:
    """key, place, band and envelope: each band's rectified, smoothed level, as a share of its greatest over the series.

    Bands are fourth-order, the smoother second-order Butterworth filters. Both are recursive, so a chunk of a series needs the
    state before it: chunks are first filtered from nothing, the states they leave are carried on as affine maps, and the chunks
    are filtered again from their true states, once for the bands and once for the smoothers. place counts from 0 without gaps;
    nulls count as 0.
    """
    first = [Filter(butterworth(4, (lo, min(hi, 0.45 * rate)), rate)) for lo, hi in bands]
    second = [Filter(butterworth(2, min(smooth, 0.4 * rate), rate)) for _ in bands]
    item = F.struct(F.col(place).alias("p"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("y"))
    rows = series.groupBy(F.col(key).alias("key"), F.floor(F.col(place) / chunk).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda z: z["y"]).alias("y"))
    rows = kept(rows)
    ends = lambda c: rows_now.select("key", "chunk", F.size("y").alias("n"), c.alias("left"))
    rows_now = rows
    begin = _carried(ends(_filtered(F.col("y"), first, second, None, None)), first).withColumnRenamed("state", "s1")
    rows_now = kept(rows.join(begin, ["key", "chunk"]))
    later = _carried(ends(_filtered(F.col("y"), first, second, F.col("s1"), None)), second).withColumnRenamed("state", "s2")
    made = kept(rows_now.join(later, ["key", "chunk"]).select("key", "chunk", F.posexplode(_filtered(F.col("y"), first, second, F.col("s1"), F.col("s2"))).alias("band", "v")))
    top = made.groupBy("key", "band").agg(F.max(F.array_max("v")).alias("_top"))
    out = made.join(top, ["key", "band"]).select("key", "band", "chunk", "_top", F.posexplode("v").alias("i", "v"))
    return out.select(F.col("key").alias(key), (F.col("chunk") * chunk + F.col("i")).alias(place), "band", (F.col("v") / (F.col("_top") + 1e-9)).alias("envelope"))
