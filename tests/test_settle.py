"""How long a take moves after a step, against a plain version on arrays and all sign patterns."""

import itertools
import math

import numpy as np
import pytest

from tessera.operators import settle

KEY = ["take"]


def plain_differences(scores, steps):
    """{(at, lag): (param, d)} of one take: scores an array with nan, steps a list of (param, frame)."""
    at = sorted({f for _, f in steps})
    found = {}
    for f, end in zip(at, [*at[1:], len(scores)]):
        here = [p for p, g in steps if g == f]
        half = (end - f) // 2
        rest = scores[f + half : end]
        rest = rest[np.isfinite(rest)]
        for lag in range(half):
            if rest.size and np.isfinite(scores[f + lag]):
                found[f, lag] = (here[0] if len(here) == 1 else 0, scores[f + lag] - np.median(rest))
    return found


def _frames(spark, scores):
    rows = [(t, i, None if math.isnan(v) else float(v)) for t, s in scores.items() for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "take int, frame long, score double")


def _steps(spark, steps):
    return spark.createDataFrame([(t, p, f) for t, s in steps.items() for p, f in s], "take int, param int, frame long")


@pytest.mark.parametrize("seed", [1, 2])
def test_differences_equal_a_plain_version(spark, seed):
    rng = np.random.default_rng(seed)
    scores = {t: np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 9, n).astype(float)) for t, n in ((0, 300), (1, 40), (2, 7))}
    steps = {t: [(int(rng.integers(1, 4)), int(f)) for f in rng.integers(0, len(s), max(1, len(s) // 9))] for t, s in scores.items()}
    steps[0] += [steps[0][0], (2, 0)]
    got = settle.differences(_frames(spark, scores), _steps(spark, steps), key=KEY).collect()
    want = {(t, *k): v for t in scores for k, v in plain_differences(scores[t], steps[t]).items()}
    assert len(got) == len(want)
    assert {(r.take, r.at, r.lag): (r.param, r.d) for r in got} == want


def test_a_step_at_the_end_or_without_settled_frames_tells_nothing(spark):
    scores = {0: np.array([1.0, 2.0, np.nan, np.nan, 5.0])}
    assert settle.differences(_frames(spark, scores), _steps(spark, {0: [(1, 0), (1, 4)]}), key=KEY).count() == 0
    empty = spark.createDataFrame([], "take int, param int, frame long")
    assert settle.differences(_frames(spark, scores), empty, key=KEY).count() == 0


def _patterns(d):
    """Half the two-sided p-value over all sign patterns of the ranks."""
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    plus = ranks[np.array(d) > 0].sum()
    sums = np.array([sum(r for r, up in zip(ranks, signs) if up) for signs in itertools.product([0, 1], repeat=len(d))])
    return min(0.5, (sums >= plus).mean(), (sums <= plus).mean())


def test_signed_rank_is_exact_for_few_untied_steps(spark):
    rng = np.random.default_rng(3)
    groups = {k: list(rng.permutation(np.arange(1, n + 1)) * rng.choice([-1, 1, 1], n) * 1.0) for k, n in enumerate((1, 2, 5, 9, 12))}
    df = spark.createDataFrame([(k, float(v)) for k, d in groups.items() for v in d], "k int, d double")
    for r in settle.signed_rank(df, key=["k"], value="d").collect():
        assert r.tail == pytest.approx(_patterns(groups[r.k]), abs=1e-12)
        assert r.steps == len(groups[r.k])
        assert 0.5 * math.erfc(r.z / math.sqrt(2)) == pytest.approx(r.tail, rel=1e-6)


def test_ties_zeros_and_many_steps_take_the_normal_score(spark):
    rng = np.random.default_rng(4)
    groups = {0: [1.0, -1.0, 2.0, 3.0], 1: [0.0, 1.0, -2.0, 3.0], 2: list(rng.normal(0.3, 1, 80)), 3: [0.0, 0.0]}
    df = spark.createDataFrame([(k, float(v)) for k, d in groups.items() for v in [*d, None] if v is not None] + [(2, None)], "k int, d double")
    got = {r.k: r for r in settle.signed_rank(df, key=["k"], value="d").collect()}
    assert set(got) == {0, 1, 2}  # without a value other than zero there is no test
    for k, r in got.items():
        d = np.array([v for v in groups[k] if v])
        rank = np.array([(np.abs(d) < abs(v)).sum() + ((np.abs(d) == abs(v)).sum() + 1) / 2 for v in d])
        assert r.tail is None and r.steps == len(groups[k])
        assert r.z == pytest.approx(abs((np.sign(d) * rank).sum()) / math.sqrt((rank**2).sum()))


def _lags(spark, rows):
    return spark.createDataFrame(rows, "program int, param int, lag long, steps long, tests long, departs boolean")


def test_lags_form_a_fixed_sequence(spark):
    def lags(program, param, departs, steps=40):
        return [(program, param, k, steps, 2, v == "x") for k, v in enumerate(departs)]

    rows = lags(0, 0, "xxxx.x.") + lags(0, 1, "x......")  # the x at 5 follows a lag that did not depart
    rows += lags(1, 0, "..xxx", 3) + lags(1, 1, ".x...", 3)  # later lags need a landing one
    rows += lags(2, 0, ".") + lags(3, 0, "xx")
    got = {r.program: r for r in settle.settles(_lags(spark, rows), program=["program"]).collect()}
    assert {k: r.settle for k, r in got.items()} == {0: 3, 1: 1, 2: 0, 3: 1}
    assert got[0].hold == 5 and got[0].bounded and got[0].next_steps == 40
    assert not got[1].bounded and got[1].next_steps == 3
    assert got[2].next_steps == 0 and got[3].next_steps == 0
    assert {r.least for r in got.values()} == {settle.least_steps(2)}


def test_fewer_than_the_least_steps_cannot_depart():
    for tests in (1, 3, 40):
        n = settle.least_steps(tests)
        bound = 0.5 * math.erfc(settle.critical(tests) / math.sqrt(2))
        assert 0.5**n <= bound * (1 + 1e-9) < 0.5 ** (n - 1)


def test_a_slow_program_is_found_to_settle_late(spark):
    rng = np.random.default_rng(5)
    n, gap, slow = 1200, 12, 3
    scores = {}
    for take in (0, 1):
        s = rng.normal(0, 1, n)
        for f in range(0, n, gap):
            s[f : f + slow] += 6
        scores[take] = s
    steps = {t: [(1 + (f // gap) % 2, f) for f in range(0, n, gap)] for t in scores}
    from pyspark.sql import functions as F

    diffs = settle.differences(_frames(spark, scores), _steps(spark, steps), key=KEY).withColumn("program", F.lit(7))
    r = settle.settles(settle.lag_tests(diffs, program=["program"]), program=["program"]).first()
    assert (r.program, r.settle, r.hold, r.bounded) == (7, slow - 1, slow + 1, True)


def test_only_changed_writes_are_steps(spark):
    rows = [(0, 1, 0, 0), (0, 1, 1, 5), (0, 1, 2, 5), (0, 1, 3, None), (0, 1, 4, 0), (0, 2, 5, 5), (1, 1, 0, 5)]
    writes = spark.createDataFrame(rows, "take int, param int, frame long, value int")
    got = settle.changed_steps(writes, key=KEY, order=["frame"]).collect()
    assert sorted((r.take, r.param, r.frame) for r in got) == [(0, 1, 1), (0, 1, 4), (0, 2, 5), (1, 1, 0)]
