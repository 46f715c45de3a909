"""Feasible lines against an exhaustive solver: every pair of constraints, and every edge between them."""

from itertools import combinations

import numpy as np
import pytest

from tessera.operators import lines


def exhaustive(rows):
    """Slack, range of periods and the constrained least squares of brackets (n, lo, hi), over all pairs of constraints."""
    rows = np.array(rows, float)
    n, lo, hi = rows.T

    def corners(w):
        half = [(1.0, x, v + w) for x, _, v in rows] + [(-1.0, -x, -(v - w)) for x, v, _ in rows]  # a u + b p <= c
        found = []
        for (a, b, c), (d, e, f) in combinations(half, 2):
            det = a * e - b * d
            if abs(det) > 1e-12:
                u, p = (c * e - b * f) / det, (a * f - c * d) / det
                if all(g * u + h * p <= k + 1e-7 for g, h, k in half):
                    found.append((u, p))
        return found

    slack = 0.0
    if not corners(0.0):
        low, high = 0.0, 1e4
        for _ in range(60):
            slack = (low + high) / 2
            low, high = (low, slack) if corners(slack) else (slack, high)
        slack = high
    c = np.array(corners(slack + 1e-9 if slack else 0.0))
    mid = (lo + hi) / 2
    cost = lambda q: ((mid - q[..., 0, None] - q[..., 1, None] * n) ** 2).sum(-1)
    free = np.polyfit(n, mid, 1)[::-1]
    w = slack + 1e-7
    if all(lo - w <= free[0] + free[1] * n) and all(free[0] + free[1] * n <= hi + w):
        best = free
    else:
        a, b = (x.ravel() for x in np.meshgrid(range(len(c)), range(len(c))))
        share = np.linspace(0, 1, 2001)[:, None, None]
        path = c[a] + share * (c[b] - c[a])
        path = path.reshape(-1, 2)
        best = path[np.argmin(cost(path))]
    return slack, c[:, 1].min(), c[:, 1].max(), float(cost(np.array(best)))


@pytest.mark.parametrize("seed", range(3))
def test_lines_equal_exhaustive_solver(spark, seed):
    rng = np.random.default_rng(seed)
    held, rows = {}, []
    for key in range(25):
        m = int(rng.integers(2, 9))
        n = np.sort(rng.choice(30, m, replace=False))
        t = 5 + 2.5 * n + rng.normal(0, rng.choice([0.5, 3.0, 9.0]), m)
        wide = rng.uniform(0.5, 6, m)
        own = [(int(a), float(b - c), float(b + c)) for a, b, c in zip(n, t, wide)]
        own += own[:1]
        held[key] = exhaustive(own), own
        rows += [(key, *r) for r in own]
    rows += [(99, 3, 1.0, 2.0), (98, None, 1.0, 2.0), (97, 1, 0.0, 1.0), (97, 1, 0.5, 2.0)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "key long, n long, lo double, hi double").repartition(parts)
        made = {r.key: r for r in lines.feasible_lines(df, key="key", n="n", lo="lo", hi="hi").collect()}
        assert set(made) == {*held, 99, 97} and made[99].slack is None and made[97].period is None and made[97].brackets == 2
        for key, ((slack, low, high, cost), own) in held.items():
            r = made[key]
            assert r.brackets == len(own) and r.slack == pytest.approx(slack, abs=1e-5)
            assert (r.period_low, r.period_high) == (pytest.approx(low, abs=1e-3), pytest.approx(high, abs=1e-3))
            n, lo, hi = np.array(own).T
            line = r.u + n * r.period
            assert (line >= lo - r.slack - 1e-6).all() and (line <= hi + r.slack + 1e-6).all()
            assert ((line - (lo + hi) / 2) ** 2).sum() <= cost + 1e-3 * max(cost, 1)


def test_hull_of_many_points():
    rng = np.random.default_rng(1)
    points = np.stack([rng.integers(0, 500, 5000), rng.normal(size=5000)], 1)
    top = lines.hull(points, True)
    for slope in rng.normal(size=50):
        assert (points[:, 1] - slope * points[:, 0]).max() == pytest.approx((top[:, 1] - slope * top[:, 0]).max())
    assert len(top) < 60 and (np.diff(np.diff(top[:, 1]) / np.diff(top[:, 0])) < 0).all()
