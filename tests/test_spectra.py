"""Spectrograms and envelopes of series cut into many ranges, against plain versions over the whole series."""

import numpy as np
import pytest

from tessera.operators import spectra

BANDS = [(1.0, 4.0), (4.0, 9.0), (10.0, 30.0)]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    return {"long": rng.normal(size=1500).cumsum() * 0.1 + rng.normal(size=1500), "short": rng.normal(size=30), "one": np.array([2.0])}


@pytest.fixture(scope="module")
def frame(spark, series):
    rows = [(k, i, float(v), len(x)) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "key string, place long, y double, n long").repartition(5)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_spectrogram(frame, series, chunk):
    made = {(r.key, r.frame): r.bands for r in spectra.band_spectrogram(frame, key="key", place="place", value="y", size="n", n_fft=64, hop=20, bands=6, chunk=chunk).collect()}
    held = {}
    for k, x in series.items():
        x = np.pad(x, (0, max(0, 64 - len(x))))
        for f in range((len(x) - 64) // 20 + 1):
            size = [abs(sum(x[20 * f + j] * np.hanning(64)[j] * np.exp(-2j * np.pi * b * j / 64) for j in range(64))) for b in range(33)] if f % 20 == 0 else np.abs(np.fft.rfft(x[20 * f : 20 * f + 64] * np.hanning(64)))
            cuts = [*spectra.band_edges(64, 6), 33]
            held[k, f] = [np.log1p(sum(size[a:b])) for a, b in zip(cuts, cuts[1:])]
    assert made.keys() == held.keys()
    for at, bands in held.items():
        assert made[at] == pytest.approx(bands)


def plain_filter(x, biquads):
    """Each biquad's difference equation, sample by sample."""
    for b0, b1, b2, a1, a2 in biquads:
        y = np.zeros(len(x))
        for i in range(len(x)):
            past = lambda v, k: v[i - k] if i >= k else 0.0  # noqa: E731, B023
            y[i] = b0 * x[i] + b1 * past(x, 1) + b2 * past(x, 2) - a1 * past(y, 1) - a2 * past(y, 2)
        x = y
    return x


@pytest.mark.parametrize("chunk", [117, 10_000])
def test_envelopes(frame, series, chunk):
    made = spectra.band_envelopes(frame, key="key", place="place", value="y", rate=64.0, bands=BANDS, smooth=3.0, chunk=chunk).collect()
    got = {(r.key, r.band, r.place): r.envelope for r in made}
    assert len(got) == len(made) == sum(map(len, series.values())) * len(BANDS)
    for k, x in series.items():
        for band, (lo, hi) in enumerate(BANDS):
            level = np.abs(plain_filter(x, spectra.butterworth(4, (lo, min(hi, 0.45 * 64)), 64.0)))
            held = plain_filter(level, spectra.butterworth(2, 3.0, 64.0))
            held /= held.max() + 1e-9
            assert [got[k, band, i] for i in range(len(x))] == pytest.approx(held, abs=1e-9)


def test_filters_pass_what_they_should():
    def gain(biquads, f, rate):
        z = np.exp(-2j * np.pi * f / rate)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in biquads]))

    low, band = spectra.butterworth(2, 3.0, 64.0), spectra.butterworth(4, (4.0, 9.0), 64.0)
    assert gain(low, 0, 64) == pytest.approx(1) and gain(low, 3.0, 64) == pytest.approx(0.5**0.5) and gain(low, 31.9, 64) < 1e-3
    assert gain(band, 4.0, 64) == pytest.approx(0.5**0.5) and gain(band, 9.0, 64) == pytest.approx(0.5**0.5) and gain(band, 6.05, 64) == pytest.approx(1, abs=1e-3)
    assert gain(band, 1.0, 64) < 1e-3 and gain(band, 25.0, 64) < 1e-3 and len(band) == 4
