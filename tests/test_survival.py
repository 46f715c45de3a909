"""What an output keeps of its source, against a plain version on arrays."""

import math

import numpy as np
import pytest

from tessera.functions import special
from tessera.operators import survival

NAN = float("nan")


def plain_lead(s_si, s_ti, o_si, o_ti, lead):
    """Statistics of one span (arrays by frame, nan where unmeasured) at one lead."""
    n = len(s_si)
    pairs = [(s_si[i - lead], s_ti[i - lead], o_si[i], o_ti[i]) for i in range(lead, n)]
    level = np.array([(a, c) for a, _, c, _ in pairs if not (math.isnan(a) or math.isnan(c))]).reshape(-1, 2)
    moved = np.array([(b, d) for _, b, _, d in pairs if not (math.isnan(b) or math.isnan(d))]).reshape(-1, 2)
    k, follow, z = len(moved), 0.0, 0.0
    if k > 2:
        serial = 1.0
        for x in moved.T:
            x = x - x.mean()
            serial *= (x[:-1] * x[1:]).sum() / (x * x).sum() if np.ptp(x) > 0 else 0.0
        if np.ptp(moved[:, 0]) > 0 and np.ptp(moved[:, 1]) > 0:
            follow = np.corrcoef(moved.T)[0, 1]
        effective = k * (1 - serial) / (1 + serial)
        z = math.atanh(min(1 - 1e-12, max(-1 + 1e-12, follow))) * math.sqrt(effective - 3) if effective > 3 else 0.0
    means = [float(m.mean()) if len(m) else 0.0 for m in (level[:, 0], moved[:, 0], level[:, 1], moved[:, 1])]
    return [k, *means, follow, z]


def plain_best(span, leads):
    found = [(lead, plain_lead(*span, lead)) for lead in leads]
    return max(found, key=lambda f: (f[1][-1], -f[0]))


def _series(spark, spans):
    rows = []
    for key, span in spans.items():
        rows += [(key, i, *[None if i % 2 and math.isnan(v) else float(v) for v in at]) for i, at in enumerate(zip(*span))]
    return spark.createDataFrame(rows, "k int, frame long, s_si double, s_ti double, o_si double, o_ti double")


def _span(rng, n, lead=0, noise=0.5, gaps=0.15):
    s = rng.normal(5, 2, (2, n))
    o = np.roll(s, lead, axis=1) * 0.5 + rng.normal(0, noise, (2, n))
    both = np.vstack([s, o])
    return [np.where(rng.random(n) < gaps, NAN, row) for row in both]


@pytest.fixture(scope="module")
def spans():
    rng = np.random.default_rng(11)
    found = {k: _span(rng, n, lead) for k, (n, lead) in enumerate([(60, 0), (60, 1), (45, 2), (9, 0), (4, 1), (2, 0), (1, 0)])}
    found[7] = [np.full(20, 3.0), np.full(20, 1.0), rng.normal(size=20), rng.normal(size=20)]  # a still source
    found[8] = [np.full(6, NAN)] * 4
    ramp = np.arange(12.0)
    found[9] = [ramp, ramp, ramp, ramp]  # follows exactly
    return found


def test_survival_equals_a_plain_version(spark, spans):
    got = {r.k: r for r in survival.survival(_series(spark, spans), key=["k"]).collect()}
    assert set(got) == set(spans)
    for k, span in spans.items():
        lead, want = plain_best(span, survival.LEADS)
        r = got[k]
        assert r.lead == lead
        assert [r.frames, r.source_si, r.source_ti, r.output_si, r.output_ti, r.follow, r.z] == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert r.following == (r.z > survival.critical(2))
        assert (r.si_ratio is None) == (r.source_si <= 0)
    assert got[0].following and got[1].lead == 1 and got[1].following and not got[7].following


def test_any_cut_into_ranges_gives_the_same(spark, spans, monkeypatch):
    rows = lambda: sorted(map(repr, (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in survival.lead_stats(_series(spark, spans), key=["k"], leads=[0, 1, 3]).collect())))
    whole = rows()
    dealt = survival.dealt
    monkeypatch.setattr(survival, "dealt", lambda df, **by: dealt(df, **by, ranges=3))
    assert rows() == whole


def test_bars_are_judged_in_order_of_faults(spark):
    rng = np.random.default_rng(2)
    n, live = 40, lambda: rng.uniform(4, 9, 40)
    source, motion = live(), live()
    good = dict(o_si=source, o_ti=motion, flashing=[False] * n, structured=[True] * n, still=False)
    bars = {
        0: (good, None),
        1: (good | dict(flashing=[False] * 5 + [True] + [False] * 34), "flashing"),
        2: (good | dict(flashing=[True] + [False] * 39), None),  # across the bar's edge
        3: (good | dict(structured=[True] * 20 + [False] * 20), "flat"),
        4: (good | dict(structured=[True] * 21 + [False] * 19), None),
        5: (good | dict(o_si=np.full(n, 0.01)), "flat"),
        6: (good | dict(o_ti=np.full(n, 0.01)), "frozen"),
        7: (good | dict(o_ti=live(), still=True), "frozen"),
        8: (good | dict(still=True), None),  # it follows
        9: (good | dict(structured=[None] * 40, o_si=np.full(n, NAN), o_ti=np.full(n, NAN)), "flat"),  # nothing shown
        10: (good | dict(flashing=[False, True] + [False] * 38, structured=[False] * 40), "flashing"),
    }
    rows = [(k, i, float(source[i]), float(motion[i]), float(b["o_si"][i]), float(b["o_ti"][i]), b["flashing"][i], b["structured"][i], b["still"]) for k, (b, _) in bars.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k int, frame long, s_si double, s_ti double, o_si double, o_ti double, flashing boolean, structured boolean, still boolean")
    got = {r.k: r.fault for r in survival.judged_bars(df, key=["k"], noise_si=0.01, noise_ti=0.01).collect()}
    assert got == {k: fault for k, (_, fault) in bars.items()}


def _plain_pooled(settings, ambiguity):
    found = []
    for a in range(ambiguity + 1):
        best = [plain_best(span, [k + a for k in survival.LEADS])[1] for span in settings]
        u = np.array([-2 * min(0.0, math.log(2) + survival.log_tail(b[-1])) for b in best if b[0] > 2])
        if not u.size:
            found.append(0.0)
            continue
        n = float(u.size)
        if n > 2 and np.ptp(u) > 0:
            d = u - u.mean()
            rho = (d[:-1] * d[1:]).sum() / (d * d).sum()
            n = min(n, max(1.0, n * (1 - rho) / (1 + rho)))
        found.append(special.gamma_tail_z(n, u.sum() * n / u.size / 2))
    return found


def test_pooled_follow_finds_the_shift_of_a_run(spark):
    rng = np.random.default_rng(5)
    runs = {0: [_span(rng, 80, lead=2, noise=1.5) for _ in range(7)], 1: [_span(rng, 30, noise=40.0) for _ in range(5)], 2: [_span(rng, 3) for _ in range(2)], 3: [_span(rng, 200, noise=0.01, gaps=0)] * 4}
    flat = {100 * r + i: span for r, spans in runs.items() for i, span in enumerate(spans)}
    from pyspark.sql import functions as F

    df = _series(spark, flat).withColumn("run", F.expr("k div 100"))
    pooled = survival.pooled_follow(df, run=["run"], setting="k", ambiguity=2).persist()
    got = {(r.run, r.shift): r.pooled_z for r in pooled.collect()}
    for r, spans in runs.items():
        assert [got[r, a] for a in range(3)] == pytest.approx(_plain_pooled(spans, 2), rel=1e-5, abs=1e-6)
    chosen = {r.run: r for r in survival.select_shift(pooled, run=["run"], shifts=3).collect()}
    assert chosen[1]["shift"] is None and chosen[3]["shift"] == 0
    assert chosen[0].best in (1, 2)  # leads 0 and 1 of shift 1 and 2 both hold the lag of two frames
    assert got[2, 2] == 0.0


def test_one_shift_needs_no_margin_and_ties_take_the_least(spark):
    rows = spark.createDataFrame([(0, 0, 4.0), (1, 0, 9.0), (1, 1, 9.0), (2, 0, 1.0), (2, 1, 9.0)], "run int, shift int, pooled_z double")
    got = {r.run: r for r in survival.select_shift(rows, run=["run"], shifts=2).collect()}
    assert (got[0].best, got[0]["shift"], got[0].margin_z) == (0, 0, None)
    assert (got[1].best, got[1]["shift"]) == (0, None)
    assert (got[2].best, got[2]["shift"]) == (1, 1) and got[2].margin_z == pytest.approx(8 / math.sqrt(2))


def test_log_tail_goes_on_where_the_tail_underflows():
    assert survival.log_tail(0.0) == pytest.approx(math.log(0.5))
    assert survival.log_tail(30.0) == pytest.approx(survival.log_tail(29.999999), rel=1e-6)
    steps = np.diff([survival.log_tail(z) for z in np.arange(28, 60, 0.5)])
    assert (np.diff(steps) < 0).all()  # concave all along
