"""Steps in pools and what they moved, against a plain version on arrays."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tessera.functions import special
from tessera.operators import moves
from tessera.plans import moved


def plain(frames, steps, spans, reach, sigma, quantum):
    """frames: out and src arrays of one take; steps: (param, frame, span, verdict). Pools as {(param, pool): row}, without a bound."""
    out, src = frames
    n = len(out)
    inside = [s for s in steps if s[1] - s[2] >= 0 and s[1] < n - reach]
    covered = {f for _, f, s, _ in inside for f in range(f - s + 1, f + reach + 1)}
    change = lambda x, f, s: abs(x[f] - x[f - s])
    controls = {s: [f for f in range(s, n) if not any(g in covered for g in range(f - s + 1, f + 1))] for s in spans}
    cells = lambda s: set(range(s[1] - s[2] + 1, s[1] + 1))

    def score(f, s):
        own = controls[s]
        if len(own) < 2:
            return None
        k = max(1, round(math.sqrt(len(own))))
        ranked = sorted(own, key=lambda c: (change(src, c, s), c))
        at = sum(change(src, c, s) < change(src, f, s) for c in own)
        window = [c for c in ranked[max(0, at - k - 1) : at + k + 1] if c != f]
        near = sorted(window, key=lambda c: abs(change(src, c, s) - change(src, f, s)))[:k]
        ref = np.array([change(out, c, s) for c in near])
        centre = np.median(ref)
        r = change(out, f, s) - centre
        return r, r / max(1.4826 * np.median(abs(ref - centre)), quantum)

    def test(alone, lag):
        """(z, steps, effect, least p, steps measured) of the steps moved by a lag."""
        ps, rs, measured = [], [], 0
        for f, s in sorted(((f + lag, s) for f, s in alone), key=lambda x: (x[1], x[0])):
            if f - s < 0 or f >= n:
                continue
            measured += 1
            own = score(f, s)
            if own:
                null = [score(c, s)[1] for c in controls[s]]
                above, ties = sum(v >= own[1] for v in null), sum(v == own[1] for v in null)
                ps.append((above - 0.5 * ties + 0.5) / (len(null) + 1))
                rs.append(own[0])
        if not ps:
            return None, 0, None, None, measured
        u = -2 * np.log(ps)
        m = len(u)
        eff = float(m)
        if m > 2 and np.ptp(u):
            d = u - u.mean()
            rho = (d[:-1] @ d[1:]) / (d @ d)
            eff = min(m, max(1, m * (1 - rho) / (1 + rho)))
        x, a = u.sum() * eff / m / 2, eff
        grid = np.linspace(0, max(60, 6 * x, 8 * a), 2_000_001)[1:]
        density = np.exp((a - 1) * np.log(grid) - grid - math.lgamma(a))
        if a >= 1:
            tail = np.interp(x, grid, np.cumsum(density[::-1])[::-1] * (grid[1] - grid[0]) - density * (grid[1] - grid[0]) / 2)
            z = -special.normal_quantile(min(max(tail, 1e-300), 1 - 1e-12))
        return z, m, float(np.mean(rs)), min(ps), measured

    live, noop = [s for s in inside if s[3] == "live"], [s for s in inside if s[3] == "noop"]
    near = {f for s in live for f in range(s[1] - s[2] + 1 - reach, s[1] + reach + 1)}
    rows = {}
    for pool, own, rivals in (("live", live, live), ("dead", [s for s in noop if not cells(s) & near], live + noop)):
        for param in {s[0] for s in own}:
            mine = {(s[1], s[2]) for s in own if s[0] == param}
            other = [s for s in rivals if s[0] != param]
            alone = {(f, s) for f, s in mine if not any(cells((0, f, s)) & cells(o) for o in other)}
            partners = None
            if not alone:
                alone = mine
                partners = sorted({o[0] for o in other if any(cells((0, f, s)) & cells(o) for f, s in mine)})
            best = None
            for lag in moves.LAGS:
                found = (lag, *test(alone, lag))
                if found[1] is not None and (best is None or found[1] > best[1]):
                    best = found
            early = test({(f, s) for f, s in alone if f - 1 not in covered}, -1)
            rows[param, pool] = (best, early[0], len(mine) - len(alone) if not partners else len(mine), partners, len(alone))
    return rows


@pytest.fixture(scope="module")
def found(spark):
    frames, steps = moved.takes(spark, "/root/testdata/sf0.001")
    return frames.collect(), steps.collect(), moves.acted_upon(frames, steps, spans=moved.SPANS, quantum=0.01).collect()


def test_acted_upon_equals_plain(found):
    frames, steps, rows = found
    takes, of = defaultdict(dict), defaultdict(list)
    for r in frames:
        takes[r.take][r.frame] = (r.out, r.src)
    for r in steps:
        of[r.take].append((r.param, r.frame, r.span, r.verdict))
    held = {}
    for take, own in takes.items():
        series = np.array([own[k] for k in range(len(own))]).T
        held |= {(take, *k): v for k, v in plain(series, of[take], moved.SPANS, 1, moves.SIGMA, 0.01).items()}
    assert {(r.take, r.param, r.pool) for r in rows} == held.keys()
    assert len({r.critical for r in rows}) == 1
    assert special.normal_cdf(-rows[0].critical) * len(rows) * 3 == pytest.approx(special.normal_cdf(-moves.SIGMA))
    compared = 0
    for r in rows:
        best, early, jointly, partners, alone = held[r.take, r.param, r.pool]
        assert (r.jointly, r.partners) == (jointly, partners)
        assert r.moved == (r.z > r.critical)
        if best is None:
            assert r.steps == 0 and r.z == 0
            continue
        assert (r.lag, r.steps, r.unmatched) == (best[0], best[2], best[5] - best[2])
        assert r.z == pytest.approx(best[1], abs=1e-3) and r.effect == pytest.approx(best[3]) and r.least_p == pytest.approx(best[4])
        assert (r.before is None) == (early is None) and (early is None or r.before == pytest.approx(early, abs=1e-3))
        compared += 1
    assert compared > 20


def test_a_step_that_moves_is_told_from_one_that_does_not(spark):
    rng = np.random.default_rng(4)
    n = 3000
    src, out = np.cumsum(rng.random(n)), rng.normal(size=n)
    steps = [(7, p, f, 1, "live") for p, start in ((1, 20), (2, 35)) for f in range(start, n - 5, 30)]
    out[[f for _, p, f, *_ in steps if p == 1]] += 6.0
    frames = spark.createDataFrame([(7, i, float(out[i]), float(src[i])) for i in range(n)], "take long, frame long, out double, src double")
    made = moves.acted_upon(frames, spark.createDataFrame(steps, "take long, param int, frame long, span int, verdict string"), spans=[1]).collect()
    assert {r.param: r.moved for r in made} == {1: True, 2: False}
    assert all(r.partners is None and r.jointly == 0 for r in made)
    assert moves.acted_upon(frames.limit(0), spark.createDataFrame([], "take long, param int, frame long, span int, verdict string"), spans=[1]).collect() == []


def test_steps_that_land_together_are_tested_with_their_partners(spark):
    rows = [(1, p, f, 2, "live") for f in (5, 15, 25) for p in (1, 2)] + [(1, 3, 40, 2, "noop"), (1, 3, 26, 1, "noop"), (1, 1, 45, 1, "unchanged")]
    pools = moves.step_pools(spark.createDataFrame(rows, "take long, param int, frame long, span int, verdict string"), reach=1).collect()
    assert sorted((r.param, r.pool, r.frame, r.alone, r.partners) for r in pools if r.pool == "live") == sorted((p, "live", f, True, [3 - p]) for f in (5, 15, 25) for p in (1, 2))
    assert [(r.param, r.frame, r.alone, r.partners) for r in pools if r.pool == "dead"] == [(3, 40, True, None)]


def test_gamma_tail():
    for k in (1, 2, 5, 40):
        for x in (0.1, 1.0, 5.0, 60.0):
            assert math.exp(special.gamma_tail_log(k, x)) == pytest.approx(special.chi_square_tail(2 * x, 2 * k), rel=1e-9)
    assert special.gamma_tail_z(1.5, 2000.0) > 36
