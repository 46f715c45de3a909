"""Array metrics of frames and series: pure numpy kernels and their Arrow UDFs.

Kernels take one array and give plain numbers; the UDFs hand Spark batches to them. A null or wrongly sized array gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.special import beta_quantile, fisher_g_critical, normal_quantile


def array_metric(kernel: Callable[..., dict[str, float]], names: list[str], **options) -> Callable[..., Column]:
    """A struct column of doubles from one or two array columns."""
    kind = pa.struct([(n, pa.float64()) for n in names])

    def run(*columns: Column) -> Column:
        def of(*arrays: pa.Array) -> pa.Array:
            # the values of a batch as they lie in its buffers; an array is a slice of them
            parts = []
            for a in arrays:
                values = np.asarray(a.values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
                parts.append((values, np.asarray(a.offsets), np.asarray(a.is_valid())))
            rows = []
            for i in range(len(arrays[0])):
                if not all(valid[i] for _, _, valid in parts):
                    rows.append(None)
                    continue
                found = kernel(*(values[offsets[i] : offsets[i + 1]] for values, offsets, _ in parts), **options)
                rows.append({n: found[n] for n in names} if found else None)
            return pa.array(rows, kind)

        returns = "struct<" + ", ".join(f"{n}: double" for n in names) + ">"
        if len(columns) == 1:
            return F.arrow_udf(lambda a: of(a), returns)(*columns)
        return F.arrow_udf(lambda a, b: of(a, b), returns)(*columns)

    return run


def _square(x: np.ndarray) -> np.ndarray | None:
    n = int(round(len(x) ** 0.5))
    return x.reshape(n, n) if n * n == len(x) and n > 2 and np.isfinite(x).all() else None


def _reflect(x: np.ndarray, pad: int) -> np.ndarray:
    return np.pad(x, pad, mode="reflect")


def sobel(frame: np.ndarray) -> np.ndarray:
    """Gradient magnitude with mirrored borders."""
    p = _reflect(frame, 1)
    smooth_y = p[:-2] + 2 * p[1:-1] + p[2:]
    smooth_x = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return np.hypot(smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2])


def information(now: np.ndarray, before: np.ndarray) -> dict[str, float]:
    """Spatial information (spread of the gradient) and temporal information (spread of the change)."""
    a, b = _square(now), _square(before)
    return {} if a is None or b is None else {"si": float(sobel(a).std()), "ti": float((a - b).std())}


def temporal_split(now: np.ndarray, before: np.ndarray, quiet: float = 1e-5) -> dict[str, float]:
    """Shares of a frame change that are level and structure; a quiet change has neither."""
    if len(now) != len(before) or not len(now):
        return {}
    change = now - before
    total, level = float((change**2).mean()), float(change.mean() ** 2)
    return {"level": 0.0, "structure": 0.0} if total < quiet**2 else {"level": level / total, "structure": 1 - level / total}


def _gaussian(x: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        x = np.apply_along_axis(lambda v: np.convolve(np.pad(v, radius, mode="reflect"), k, "valid"), axis, x)
    return x


def ssim(a: np.ndarray, b: np.ndarray, span: float = 1.0, sigma: float = 1.5, radius: int = 3) -> dict[str, float]:
    """Mean structural similarity under a Gaussian window."""
    x, y = _square(a), _square(b)
    if x is None or y is None:
        return {}
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    mx, my, xx, yy, xy = (_gaussian(v, sigma, radius) for v in (x, y, x * x, y * y, x * y))
    index = (2 * mx * my + c1) * (2 * (xy - mx * my) + c2) / ((mx**2 + my**2 + c1) * (xx - mx**2 + yy - my**2 + c2))
    return {"ssim": float(index.mean())}


def radial_spectrum(frame: np.ndarray) -> dict[str, float]:
    """Log-log slope of the radially averaged power under a Hann window, its fit and the fractal dimension."""
    x = _square(frame)
    if x is None:
        return {}
    n = len(x)
    window = np.hanning(n + 2)[1:-1]
    power = np.abs(np.fft.fft2((x - x.mean()) * window[:, None] * window)) ** 2
    f = np.fft.fftfreq(n) * n
    ring = np.rint(np.hypot(f[:, None], f)).astype(int)
    mean = np.array([power[ring == k].mean() for k in range(1, n // 2)])
    if len(mean) < 2 or (mean <= 0).any():
        return {"slope": 0.0, "r2": 0.0, "dimension": 1.0}
    u, v = np.log(np.arange(1, n // 2)), np.log(mean)
    slope, base = np.polyfit(u, v, 1)
    rest = ((v - slope * u - base) ** 2).sum() / max(((v - v.mean()) ** 2).sum(), 1e-300)
    return {"slope": float(slope), "r2": float(1 - rest), "dimension": float(np.clip((7 + slope) / 2, 1, 2))}


def gabor_energy(frame: np.ndarray, wavelengths: tuple[float, ...] = (2.0, 4.0), angles: int = 4) -> dict[str, float]:
    """Share of the strongest oriented channel and the concentration of all channel energies."""
    x = _square(frame)
    if x is None:
        return {}
    n = len(x)
    grid = np.arange(n) - (n - 1) / 2
    energy = []
    for w in wavelengths:
        for k in range(angles):
            t = np.pi * k / angles
            along = grid[None, :] * np.cos(t) + grid[:, None] * np.sin(t)
            envelope = np.exp(-(grid[None, :] ** 2 + grid[:, None] ** 2) / (2 * w**2))
            for wave in (np.cos, np.sin):
                kernel = envelope * wave(2 * np.pi * along / w)
                kernel -= kernel.mean()
                kernel /= max(np.sqrt((kernel**2).sum()), 1e-12)
                energy.append(float((np.abs(np.fft.ifft2(np.fft.fft2(x) * np.fft.fft2(kernel))) ** 2).mean()))
    pair = np.array(energy).reshape(-1, 2).sum(1)
    share = pair / max(pair.sum(), 1e-300)
    return {"peak": float(share.max()), "concentration": float((share**2).sum())}


def _acf_peaks(rows: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of a matrix the strongest inner peak of the autocorrelation up to half the length: its lag, refined by a
    parabola, its height within [0, 1], and whether white noise would reach it at no lag with probability 1 - alpha."""
    count, n = rows.shape
    half = n // 2
    lag, height, real = np.zeros(count), np.zeros(count), np.zeros(count, bool)
    if half < 2:
        return lag, height, real
    level = rows - rows.mean(1, keepdims=True)
    acf = np.fft.irfft(np.abs(np.fft.rfft(level, 2 * n)) ** 2)[:, : half + 2]
    acf = acf / np.where(acf[:, :1] > 0, acf[:, :1], 1.0)
    rise = np.diff(acf)
    peaked = np.where((rise[:, :-1] > 0) & (rise[:, 1:] < 0), acf[:, 1:-1], -np.inf)
    at = peaked.argmax(1)
    has = np.isfinite(peaked[np.arange(count), at])
    left, mid, right = (np.take_along_axis(acf, at[:, None] + k, 1)[:, 0] for k in range(3))
    bend = left - 2 * mid + right
    lag[has] = (at + 1 - (right - left) / np.where(bend, 2 * bend, 1.0))[has]
    height[has] = np.clip(mid, 0, 1)[has]
    real[has] = height[has] * np.sqrt(n) >= normal_quantile(1 - alpha / (2 * half))
    return lag, height, real


@lru_cache(maxsize=4096)
def _comb_bound(alpha: float, inside: int, outside: int) -> float:
    return beta_quantile(1 - alpha, inside, outside)


def regimes(rows: np.ndarray, quiet: float = 1e-6, alpha: float = 0.05, most: int = 4) -> dict[str, np.ndarray]:
    """Kind, period, strength and winding number of series of one length, the rows of a matrix.

    Kinds: 0 static (a range of at most `quiet`), 1 periodic, 2 quasi-periodic, 3 chaotic. A series without a real period is
    chaotic; so is one whose bins at most one off a harmonic hold no more of the power than the upper alpha quantile of a
    like number of white-noise bins (Beta). A series is quasi-periodic if its two strongest lines beyond Fisher's g are more
    than a bin off every ratio of whole numbers with a denominator of at most `most`. Winding is cycles a step, 0 unless
    periodic or quasi-periodic.
    """
    count, n = rows.shape
    period, strength, real = _acf_peaks(rows, alpha)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft((rows - rows.mean(1, keepdims=True)) * hann)) ** 2
    sides = np.full(power.shape[1], 2.0)
    sides[[0] if n % 2 else [0, -1]] = 1.0
    power = (power * sides)[:, 1:]
    cycles = np.arange(1, power.shape[1] + 1)
    total = power.sum(1)
    period = np.where(real, period, 0.0)
    real &= (len(cycles) > 2) & (total > 0)
    share = power / np.where(total > 0, total, 1.0)[:, None]

    # how far a bin is off the harmonics on both its sides; a period under two steps has its first one in the last bin
    tone = (n / np.where(real, period, n / 2))[:, None]
    last = np.maximum(np.floor(len(cycles) / tone), 1)
    below = np.floor(cycles / tone)
    off = np.minimum(*(np.abs(cycles - np.minimum(np.rint(np.clip(h, 1, last) * tone), len(cycles) + 1)) for h in (below, below + 1)))
    comb = off <= 1
    width, held = comb.sum(1), (share * comb).sum(1)
    for i in np.flatnonzero(real & (width < len(cycles))):
        real[i] = held[i] > _comb_bound(alpha, int(width[i]), len(cycles) - int(width[i]))

    line = np.zeros_like(comb)
    slope = np.diff(share)
    line[:, 1:-1] = (slope[:, :-1] > 0) & (slope[:, 1:] < 0) & (share[:, 1:-1] >= fisher_g_critical(len(cycles), alpha))
    top = np.argsort(np.where(line, share, -1.0))[:, -2:] + 1
    slow, fast = top.min(1, initial=len(cycles)), top.max(1, initial=1)
    by = np.arange(1, most + 1)[:, None]
    locked = (np.abs(fast - np.rint(by * fast / slow) / by * slow) <= 1).any(0)
    kind = np.where(np.ptp(rows, axis=1) <= quiet, 0.0, np.where(~real, 3.0, np.where((line.sum(1) > 1) & ~locked, 2.0, 1.0)))
    period, strength = np.where(kind > 0, period, 0.0), np.where(kind > 0, strength, 0.0)
    turns = np.isin(kind, (1.0, 2.0))
    return {"kind": kind, "period": period, "strength": strength, "winding": np.where(turns, 1 / np.where(turns, period, 1.0), 0.0)}


REGIME = ("kind", "period", "strength", "winding")


def dynamics(series: np.ndarray, **options) -> dict[str, float]:
    """regimes() of one series."""
    return {k: float(v[0]) for k, v in regimes(series[None, :], **options).items()} if len(series) > 3 and np.isfinite(series).all() else {}


def series_regimes(series: Column, **options) -> Column:
    """Struct of regimes() for a column of series, those of one length in a batch at once; null for unfit ones."""

    @F.arrow_udf("struct<" + ", ".join(f"{k}: double" for k in REGIME) + ">")
    def run(column: pa.Array) -> pa.Array:
        values = np.asarray(column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
        start, size = np.asarray(column.offsets)[:-1], np.diff(np.asarray(column.offsets))
        out, fit = np.zeros((len(REGIME), len(column))), np.zeros(len(column), bool)
        for n in np.unique(size[size > 3]):
            at = np.flatnonzero((size == n) & np.asarray(column.is_valid()))
            rows = values[start[at][:, None] + np.arange(n)]
            good = np.isfinite(rows).all(1)
            fit[at[good]] = True
            if good.any():
                out[:, at[good]] = list(regimes(rows[good], **options).values())
        return pa.StructArray.from_arrays([pa.array(x) for x in out], list(REGIME), mask=pa.array(~fit))

    return run(series)


def best_lag(a: np.ndarray, b: np.ndarray, most: int = 16) -> dict[str, float]:
    """Lag of b against a with the greatest correlation of the standardised series, and that correlation."""
    n = min(len(a), len(b))
    if n < 4:
        return {}
    u, v = ((x[:n] - x[:n].mean()) / (x[:n].std() or 1.0) for x in (a, b))
    lags = range(-min(most, n - 2), min(most, n - 2) + 1)
    score = [float((u[max(0, -k) : n - max(0, k)] * v[max(0, k) : n - max(0, -k)]).sum() / n) for k in lags]
    best = int(np.argmax(score))
    return {"lag": float(list(lags)[best]), "r": score[best]}


def ciede2000(lab1: np.ndarray, lab2: np.ndarray) -> np.ndarray:
    """CIEDE2000 difference of Lab colours (last axis L, a, b). Constants are those of the standard."""
    L1, a1, b1 = np.moveaxis(lab1, -1, 0)
    L2, a2, b2 = np.moveaxis(lab2, -1, 0)
    mean_c7 = ((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2) ** 7
    g = 1.5 - 0.5 * np.sqrt(mean_c7 / (mean_c7 + 25.0**7))
    c1, c2 = np.hypot(a1 * g, b1), np.hypot(a2 * g, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1 * g)) % 360, np.degrees(np.arctan2(b2, a2 * g)) % 360
    turn = h2 - h1
    turn = np.where(c1 * c2 == 0, 0, np.where(turn > 180, turn - 360, np.where(turn < -180, turn + 360, turn)))
    dl, dc, dh = L2 - L1, c2 - c1, 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn / 2))
    l, c = (L1 + L2) / 2, (c1 + c2) / 2
    wide = np.abs(h1 - h2) > 180
    h = np.where(c1 * c2 == 0, h1 + h2, np.where(wide, (h1 + h2 + np.where(h1 + h2 < 360, 360, -360)) / 2, (h1 + h2) / 2))
    cos = lambda k, off: np.cos(np.radians(k * h + off))
    t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63)
    sl, sc, sh = 1 + 0.015 * (l - 50) ** 2 / np.sqrt(20 + (l - 50) ** 2), 1 + 0.045 * c, 1 + 0.015 * c * t
    rt = -np.sin(np.radians(60 * np.exp(-(((h - 275) / 25) ** 2)))) * 2 * np.sqrt(c**7 / (c**7 + 25.0**7))
    return np.sqrt((dl / sl) ** 2 + (dc / sc) ** 2 + (dh / sh) ** 2 + rt * (dc / sc) * (dh / sh))


def matching_blocks(a: list, b: list, least: int = 1) -> list[tuple[int, int, int]]:
    """Longest common blocks of two sequences, found again on either side of each, in order: (start in a, start in b, size)."""
    out, todo = [], [(0, len(a), 0, len(b))]
    places: dict = {}
    for j, v in enumerate(b):
        places.setdefault(v, []).append(j)
    while todo:
        a0, a1, b0, b1 = todo.pop()
        best, ends = (0, a0, b0), {}
        for i in range(a0, a1):
            new = {}
            for j in places.get(a[i], ()):
                if b0 <= j < b1:
                    new[j] = size = ends.get(j - 1, 0) + 1
                    if size > best[0]:
                        best = size, i - size + 1, j - size + 1
            ends = new
        size, i, j = best
        if size >= least:
            out.append((i, j, size))
            todo += [(a0, i, b0, j), (i + size, a1, j + size, b1)]
    return sorted(out)


def onsets(series: np.ndarray) -> dict[str, float]:
    """Tempo of a strength series: rises only, autocorrelation under a log-normal prior about 8 steps, and beats tracked."""
    n = len(series)
    if n < 16 or not np.isfinite(series).all():
        return {}
    rise = np.maximum(np.diff(series, prepend=series[0]), 0)
    rise = rise / (rise.max() or 1.0)
    x = rise - rise.mean()
    acf = np.correlate(x, x, "full")[n - 1 :][: n // 2]
    lags = np.arange(2, len(acf))
    period = int(lags[np.argmax(acf[2:] * np.exp(-0.5 * np.log2(lags / 8) ** 2))])
    # beats by dynamic programming: each beat follows one about a period before, squared log deviation is the cost
    score, back = rise.copy(), np.full(n, -1)
    for t in range(2, n):
        gaps = np.arange(max(1, period // 2), min(2 * period, t) + 1)
        if len(gaps):
            value = score[t - gaps] - 10 * np.log(gaps / period) ** 2
            k = int(value.argmax())
            if value[k] > 0:
                score[t], back[t] = rise[t] + value[k], t - gaps[k]
    t, beats = int(score.argmax()), 0
    while t >= 0:
        beats, t = beats + 1, int(back[t])
    return {"period": float(period), "beats": float(beats), "strength": float(score.max() / max(beats, 1))}


def novelty(matrix: np.ndarray, half: int = 4) -> np.ndarray:
    """Checkerboard novelty along the diagonal of a similarity matrix."""
    sign = np.where((np.arange(2 * half)[:, None] < half) == (np.arange(2 * half)[None, :] < half), 1.0, -1.0)
    taper = np.exp(-(((np.arange(2 * half) - half + 0.5) / half) ** 2))
    kernel = sign * taper[:, None] * taper
    padded = np.pad(matrix, half)
    return np.array([max(0.0, (padded[i : i + 2 * half, i : i + 2 * half] * kernel).sum()) for i in range(len(matrix))])
