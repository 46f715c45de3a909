"""Held pictures, torn captures and spread plans, against plain versions on arrays."""

import numpy as np
import pytest

from tessera.operators import pictures


def plain_held(frames, sigma=3.0):
    flat = [frames[0]] + [b for a, b in zip(frames, frames[1:]) if not np.array_equal(a, b)]
    if len(flat) < 4:
        return len(flat), None, True
    flat = np.array(flat)
    steps = flat[1:] - flat[:-1]
    turns = np.array([a @ b / np.sqrt((a @ a) * (b @ b)) for a, b in zip(steps, steps[1:])])
    n, pixels = flat.shape
    within = ((flat - flat.mean(axis=0)) ** 2).sum() / (pixels * (n - 1))
    ratio = n * flat.mean(axis=0).var(ddof=1) / within
    noise = abs(turns.mean() + 0.5) <= sigma * turns.std(ddof=1) / np.sqrt(len(turns))
    return n, turns.mean(), bool(noise and ratio > 1 + sigma * np.sqrt(2 / (pixels - 1) + 2 / (pixels * (n - 1))))


@pytest.fixture(scope="module")
def shots():
    rng = np.random.default_rng(8)
    picture = rng.uniform(0, 10, 40)
    found = {
        "held": picture + rng.normal(0, 0.3, (60, 40)),
        "snow": rng.normal(0, 1, (60, 40)),
        "pan": np.array([np.roll(np.sin(np.arange(40) / 4), i) for i in range(50)]) + rng.normal(0, 0.01, (50, 40)),
        "flicker": np.array([picture + (i % 2) * 3 for i in range(20)]) + rng.normal(0, 0.1, (20, 40)),
        "same": np.repeat(picture[None], 9, axis=0),
        "three": picture + rng.normal(0, 1, (3, 40)),
        "four": picture + rng.normal(0, 0.1, (4, 40)),
    }
    found["repeats"] = np.repeat(found["held"][:20], 3, axis=0)
    return found


def _shots(spark, shots, step=1):
    return spark.createDataFrame([(k, i * step, [float(v) for v in p]) for k, s in shots.items() for i, p in enumerate(s)], "k string, frame long, picture array<double>")


def test_held_equals_a_plain_version(spark, shots):
    got = {r.k: r for r in pictures.held(_shots(spark, shots), key=["k"]).collect()}
    for k, s in shots.items():
        distinct, motion, still = plain_held(s)
        r = got[k]
        assert (r.frames, r.distinct, r.still) == (len(s), distinct, still)
        assert r.motion == (None if motion is None else pytest.approx(motion, abs=1e-9))
    assert {k for k, r in got.items() if r.still} >= {"held", "same", "three", "repeats"}
    assert not got["snow"].still and not got["pan"].still and not got["flicker"].still


def test_gaps_in_the_numbers_and_null_pictures_are_no_frames(spark, shots):
    some = {k: shots[k] for k in ("held", "pan")}
    rows = _shots(spark, some, step=3).unionByName(spark.createDataFrame([("held", 1, None), ("none", 0, None)], "k string, frame long, picture array<double>"))
    got = {r.k: r for r in pictures.held(rows, key=["k"]).collect()}
    assert set(got) == {"held", "pan"} and got["held"].frames == 60 and got["held"].still


def test_pictures_of_one_number_are_not_held(spark):
    got = pictures.held(_shots(spark, {"one": np.arange(8.0)[:, None] % 3}), key=["k"]).first()
    assert (got.frames, got.distinct, got.still) == (8, 8, False)


def plain_tears(cap, src, height, width, bands, every):
    inner, own = cap[1:-1].ravel()[::every], src[1:-1].ravel()[::every]
    gain, offset = np.polyfit(own, inner, 1)
    src = gain * src + offset
    judged = torn = 0
    for top, bottom in bands:
        rows = slice(round(top * height) * width, round(bottom * height) * width)
        for i in range(1, len(cap) - 1):
            off = [np.abs(cap[i, rows] - src[j, rows]).mean() for j in (i, i - 1, i + 1)]
            apart = min(np.abs(src[i, rows] - src[j, rows]).mean() for j in (i - 1, i + 1))
            if apart > min(off):
                judged += 1
                torn += off[0] > min(off[1:])
    return gain, offset, judged, torn


def test_tears_equal_a_plain_version(spark):
    rng = np.random.default_rng(9)
    width, height, takes = 5, 7, {}
    for k, n in enumerate((40, 12, 3)):
        src = rng.uniform(0, 255, (n, width * height))
        if k == 1:
            src[4:8] = src[4]  # nothing to judge between equal neighbours
        cap = src * 0.8 + 12 + rng.normal(0, 2, src.shape)
        for i in range(1, n, 4):
            cap[i, : 3 * width] = src[i - 1, : 3 * width] * 0.8 + 12
        takes[k] = cap, src
    rows = [(k, i, a.tolist(), b.tolist()) for k, (cap, src) in takes.items() for i, (a, b) in enumerate(zip(cap, src))]
    rows += [(9, 0, rows[0][2], rows[0][3]), (9, 1, rows[1][2], rows[1][3])]  # two frames have no middle one
    df = spark.createDataFrame(rows, "k int, frame int, captured array<double>, source array<double>")
    for every in (7, 1):
        got = {r.k: r for r in pictures.tears(df, key=["k"], width=width, height=height, every=every).collect()}
        assert set(got) == set(takes)
        for k, (cap, src) in takes.items():
            gain, offset, judged, torn = plain_tears(cap, src, height, width, pictures.BANDS, every)
            assert (got[k].gain, got[k].offset) == pytest.approx((gain, offset), rel=1e-9)
            assert (got[k].judged, got[k].torn) == (judged, torn)
    assert got[0].torn >= 8


def test_a_flat_source_is_never_torn(spark):
    df = spark.createDataFrame([(0, i, [float(i % 2)] * 4, [5.0] * 4) for i in range(6)], "k int, frame int, captured array<double>, source array<double>")
    r = pictures.tears(df, key=["k"], width=1, height=4).first()
    assert (r.gain, r.judged, r.torn) == (0.0, 0, 0)


def test_restaggered_spreads_each_owner(spark):
    rows = [(0, "a", 1, 0), (0, "a", 2, 5), (0, "a", 3, 5), (0, "b", 4, 9), (0, "a", 5, 4), (1, "a", 6, 7), (1, "a", 7, 0), (1, "b", 8, None)]
    plan = spark.createDataFrame(rows, "take int, owner string, row int, target int")
    got = {r.row: r.target for r in pictures.restaggered(plan, key=["take"], owner="owner", order="row").collect()}
    assert got == {1: 0, 2: 4, 3: 5, 5: 6, 4: 9, 6: 7, 7: 0, 8: None}
