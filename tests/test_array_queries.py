"""Queries that SQL cannot express, each against an independent version on the smallest tables."""

import difflib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessera.functions import arrays, special
from tessera.plans import catalogue, signals

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def frames():
    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM '{SF}/embeddings.parquet' ORDER BY label, vec_id").fetchall()
    return [(i, label, np.array(x, np.float64).reshape(8, 8)) for i, label, x in rows]


@pytest.fixture(scope="module")
def events():
    return duckdb.sql(f"SELECT user_id, epoch_us(ts), event_id, event_type, value FROM '{SF}/events.parquet' ORDER BY 1, 2, 3").fetchall()


def pairs(frames):
    return [(i, b, a) for (j, m, a), (i, k, b) in zip(frames, frames[1:]) if m == k]


def mirrored(x, y, k):
    n = len(x)
    fold = lambda i: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    return x[fold(y), fold(k)]


def test_pair_metrics(spark, frames):
    got = {r.vec_id: r for r in QUERIES["pair_metrics"](spark, SF).collect()}
    want = pairs(frames)
    assert len(got) == len(want)
    kernel = [math.exp(-(k**2) / (2 * 1.5**2)) for k in range(-3, 4)]
    kernel = [k / sum(kernel) for k in kernel]
    near = range(-3, 4)
    for i, now, before in want[:: len(want) // 12]:
        gradient, index = [], []
        for y in range(8):
            for x in range(8):
                at = lambda dy, dx: mirrored(now, y + dy, x + dx)  # noqa: B023, E731
                gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
                gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
                gradient.append(math.hypot(gx, gy))
                w = [(kernel[dy + 3] * kernel[dx + 3], mirrored(now, y + dy, x + dx), mirrored(before, y + dy, x + dx)) for dy in near for dx in near]
                ma, mb = sum(k * a for k, a, _ in w), sum(k * b for k, _, b in w)
                va, vb, ab = sum(k * a * a for k, a, _ in w) - ma**2, sum(k * b * b for k, _, b in w) - mb**2, sum(k * a * b for k, a, b in w) - ma * mb
                index.append((2 * ma * mb + 1e-4) * (2 * ab + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4)))
        assert got[i].si == pytest.approx(np.std(gradient)) and got[i].ti == pytest.approx(np.std(now - before)) and got[i].ssim == pytest.approx(np.mean(index))


def spectrum(x):
    w = [math.sin(math.pi * (k + 1) / 9) ** 2 for k in range(8)]
    z = [[(x[a, b] - x.mean()) * w[a] * w[b] for b in range(8)] for a in range(8)]
    rings = defaultdict(list)
    for u in range(8):
        for v in range(8):
            f = sum(z[a][b] * complex(math.cos(-2 * math.pi * (u * a + v * b) / 8), math.sin(-2 * math.pi * (u * a + v * b) / 8)) for a in range(8) for b in range(8))
            rings[round(math.hypot(u - 8 * (u >= 4), v - 8 * (v >= 4)))].append(abs(f) ** 2)
    lx, ly = [math.log(k) for k in (1, 2, 3)], [math.log(np.mean(rings[k])) for k in (1, 2, 3)]
    slope = np.cov(lx, ly, bias=True)[0, 1] / np.var(lx)
    return slope, np.corrcoef(lx, ly)[0, 1] ** 2


def test_frame_metrics(spark, frames):
    got = {r.vec_id: r for r in QUERIES["frame_metrics"](spark, SF).collect()}
    assert len(got) == len(frames)
    for i, _, x in frames[:: len(frames) // 8]:
        slope, r2 = spectrum(x)
        assert got[i].slope == pytest.approx(slope) and got[i].r2 == pytest.approx(r2) and got[i].dimension == pytest.approx(min(2, max(1, (7 + slope) / 2)))
        assert 1 / 8 - 1e-9 <= got[i].peak <= 1 and got[i].peak**2 <= got[i].concentration <= got[i].peak + 1e-9


def test_oriented_energy_follows_the_grating():
    x = np.cos(2 * np.pi * np.arange(32) / 4)
    across, along = arrays.gabor_energy(np.tile(x, (32, 1)).ravel()), arrays.gabor_energy(np.tile(x[:, None], (1, 32)).ravel())
    assert across["peak"] == pytest.approx(along["peak"]) and across["peak"] > 0.5
    assert arrays.gabor_energy(np.random.default_rng(0).standard_normal(1024))["peak"] < 0.4


def test_clip_scores(spark, frames):
    got = {r.label: r for r in QUERIES["clip_scores"](spark, SF).collect()}
    clips = defaultdict(list)
    for _, label, x in frames:
        clips[label].append(x)
    assert set(got) == set(clips)
    saturate = lambda v: v / (1 + v) if v > 0 else 0
    for label, clip in clips.items():
        r, changes = got[label], [((b - a) ** 2).mean() for a, b in zip(clip, clip[1:])]
        low, high = min(changes), max(changes)
        symbols = [min(9, int((c - low) / (high - low) * 10)) for c in changes]
        steps, after = Counter(zip(symbols, symbols[1:])), Counter(symbols[:-1])
        bits = sum(-n * math.log2(n / after[a]) for (a, _), n in steps.items()) / (len(symbols) - 1)
        slope, dimension = np.mean([spectrum(x)[0] for x in clip[:1]]), r.dimension
        assert r.frames == len(clip) and r.motion == pytest.approx(np.mean(changes)) and r.surprisal == pytest.approx(bits)
        assert r.luma_std == pytest.approx(np.mean([x.std() for x in clip])) and r.clip == pytest.approx(np.mean([(np.abs(x) >= 0.3).mean() for x in clip]))
        slope = r.slope
        reward = (1 - saturate(max(1.3 - dimension, 0, dimension - 1.5))) + 0.5 * saturate(r.motion) + saturate(bits)
        penalty = r.concentration + saturate(max(-1.4 - slope, 0, slope + 1.0)) + min(1, r.clip) + 0.5 * (1 - saturate(r.luma_std))
        assert r.score == pytest.approx((reward - penalty) / sum(abs(t[2]) for t in signals.SCORE_TERMS), abs=1e-6)


def test_aligned_sequences(spark, events):
    halves = defaultdict(lambda: ([], []))
    for user, t, _, kind, _ in events:
        halves[user][t // 86_400_000_000 % 30 >= 15].append(kind)
    # difflib joins blocks that touch, so ours are joined for the comparison
    got = defaultdict(list)
    for r in sorted(QUERIES["aligned_sequences"](spark, SF).collect(), key=lambda r: (r.user_id, r.at)):
        own = got[r.user_id]
        if own and own[-1][0] + own[-1][2] == r.at and own[-1][1] + own[-1][2] == r.to:
            own[-1] = (*own[-1][:2], own[-1][2] + r.size)
        else:
            own.append((r.at, r.to, r.size))
    for user, (a, b) in halves.items():
        want = [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        assert [x for x in got[user] if x in want] == got[user]
        assert {x for x in want if x[2] >= 3} <= set(got[user])


def test_series_rhythm(spark, events):
    sums = defaultdict(lambda: defaultdict(float))
    for user, t, _, _, value in events:
        sums[user][t // 21_600_000_000] += value
    got = {r.user_id: r for r in QUERIES["series_rhythm"](spark, SF).collect()}
    for user, series in sums.items():
        x = [series[h] for h in sorted(series)]
        n = len(x)
        rise = [max(0.0, b - a) for a, b in zip([x[0], *x], x)]
        rise = [v / max(rise) for v in rise]
        mean = sum(rise) / n
        score = {k: sum((rise[i] - mean) * (rise[i + k] - mean) for i in range(n - k)) * math.exp(-0.5 * math.log2(k / 8) ** 2) for k in range(2, n // 2)}
        period = max(score, key=score.get)
        best, back = list(rise), [-1] * n
        for t in range(2, n):
            options = [(best[t - g] - 10 * math.log(g / period) ** 2, -g) for g in range(max(1, period // 2), min(2 * period, t) + 1)]
            if options and max(options)[0] > 0:
                value, g = max(options)
                best[t], back[t] = rise[t] + value, t + g
        t, beats = best.index(max(best)), 0
        while t >= 0:
            beats, t = beats + 1, back[t]
        assert (got[user].period, got[user].beats) == (period, beats) and got[user].strength == pytest.approx(max(best) / beats)


def test_dynamics_of_known_series():
    t = np.arange(1024)
    kind = lambda x: arrays.dynamics(x)["kind"]
    golden = (1 + 5**0.5) / 2
    assert kind(np.zeros(64)) == 0 and kind(np.sin(2 * np.pi * t / 16)) == 1 and kind(np.random.default_rng(1).standard_normal(1024)) == 3
    assert kind(np.sin(2 * np.pi * t / 32) + np.sin(2 * np.pi * t / 16)) == 1
    two = np.sin(2 * np.pi * t / 17) + 0.6 * np.sin(2 * np.pi * t * golden / 17)  # bins 60 and 97: far from 5 / 3
    assert kind(two) == 2
    found = arrays.dynamics(np.sin(2 * np.pi * t / 20.5))
    assert found["period"] == pytest.approx(20.5, abs=0.1) and found["winding"] == pytest.approx(1 / found["period"])


def test_series_dynamics_of_users(spark, events):
    hours = defaultdict(lambda: defaultdict(list))
    for user, t, _, _, value in events:
        hours[user][t // 3_600_000_000].append(value)
    got = {r.user_id: r for r in QUERIES["series_dynamics"](spark, SF).collect()}
    for user, series in hours.items():
        x = np.array([np.mean(series[h]) for h in sorted(series)])
        d, n = x - x.mean(), len(x)
        acf = [float((d[: n - k] * d[k:]).sum() / (d * d).sum()) for k in range(n // 2 + 2)]
        tops = [k for k in range(1, n // 2 + 1) if acf[k] > acf[k - 1] and acf[k] > acf[k + 1]]
        best = max(tops, key=acf.__getitem__)
        assert got[user].strength == pytest.approx(min(1, max(0, acf[best])))
        if acf[best] < special.normal_quantile(1 - 0.05 / (2 * (n // 2))) / math.sqrt(n):
            assert got[user].kind == 3.0 and got[user].winding == 0


def test_beta_and_fisher_bounds():
    x = np.linspace(0, 1, 200_001)
    for a, b in ((2, 3), (3, 40), (30, 400), (120, 8)):
        density = x ** (a - 1) * (1 - x) ** (b - 1)
        cdf = np.cumsum((density[1:] + density[:-1]) / 2)
        cdf /= cdf[-1]
        q = special.beta_quantile(0.95, a, b)
        assert np.interp(q, x[1:], cdf) == pytest.approx(0.95, abs=1e-4) and special.beta_cdf(q, a, b) == pytest.approx(0.95, abs=1e-9)
    assert special.fisher_g_p(special.fisher_g_critical(50, 0.05), 50) == pytest.approx(0.05)
    assert special.fisher_g_p(0.0, 50) == 1.0 and special.fisher_g_p(1.0, 50) == 0.0 and special.fisher_g_p(0.9, 1) == 1.0
