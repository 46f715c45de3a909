"""Novelty, prominent peaks and section classes against plain versions."""

from collections import defaultdict

import numpy as np
import pytest

from tessera.operators import sections as s
from tessera.plans import catalogue


def plain_novelty(x, kernel):
    n = len(x)
    half = max(1, min(kernel // 2, n // 2))
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    like = unit @ unit.T
    w = s.checkerboard(half)
    at = lambda i: min(max(i, 0), n - 1)
    return np.array([sum(w[a + half] * w[b + half] * like[at(i + a), at(i + b)] for a in range(-half, half + 1) for b in range(-half, half + 1)) for i in range(n)])


def plain_peaks(x, distance, bound):
    """By scanning: a peak's nearest higher place on either side, and the lowest point on the way."""
    found = []
    for i in range(1, len(x) - 1):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            found.append((i + j) // 2)
    kept = []
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        lows = []
        for step in (-1, 1):
            i, low = p, x[p]
            while 0 <= i < len(x) and x[i] <= x[p]:
                low = min(low, x[i])
                i += step
            lows.append(low)
        if x[p] - max(lows) >= bound:
            out.append(p)
    return out


def plain_sections(x, kernel=16, distance=6, sigma=1.0):
    v = plain_novelty(x, kernel)
    v = v - v.min()
    v = v / (v.max() + 1e-9)
    starts = [0, *plain_peaks(v, distance, sigma * v.std())] if len(x) > 3 else [0]
    ends = [*starts[1:], len(x)]
    means = [x[a:b].mean(0) for a, b in zip(starts, ends)]
    cos = lambda a, b: a @ b / ((np.linalg.norm(a) + 1e-9) * (np.linalg.norm(b) + 1e-9))
    off = [cos(a, b) for i, a in enumerate(means) for j, b in enumerate(means) if i != j]
    bound, names = np.median(off) if off else 1.0, []
    for k, m in enumerate(means):
        likes = [cos(m, means[j]) for j in range(k)]
        names.append(names[int(np.argmax(likes))] if likes and max(likes) > bound else len(set(names)))
    return list(zip(starts, ends, names))


def test_sections_of_every_label(spark):
    for sf in ("sf0.001", "sf0.01"):
        held = defaultdict(list)
        for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect():
            held[r.label].append(r.embedding)
        made = defaultdict(list)
        for r in catalogue.queries()["label_sections"](spark, f"/root/testdata/{sf}").collect():
            made[r.label].append((r.section, r.start, r.end, r["class"]))
        assert made.keys() == held.keys()
        for label, x in held.items():
            assert [r[1:] for r in sorted(made[label])] == plain_sections(np.array(x, float))


def test_blocks_are_found_again_whatever_the_chunks(spark):
    rng = np.random.default_rng(2)
    parts = np.eye(8)
    order = [0, 1, 0, 2, 1]
    x = np.concatenate([parts[k] + 0.05 * rng.normal(size=(30, 8)) for k in order])
    rows = [("a", i, v.tolist()) for i, v in enumerate(x)] + [("b", 5, [1.0] * 8), ("c", 1, None)]
    df = spark.createDataFrame(rows, "key string, i long, x array<double>")
    made = s.sections(df, key="key", order="i", vector="x").orderBy("key", "start").collect()
    assert [(r.start, r.end, r["class"]) for r in made[:-1]] == plain_sections(x) and made[-1].key == "b"
    assert all(abs(r.start - 30 * r.section) <= 1 for r in made[:-1]) and made[-1].end == 1
    placed = df.where("key = 'a'").selectExpr("key", "i as place", "x", "150L as n")
    whole, cut = ({r.place: r.novelty for r in s.novelty(placed, key="key", place="place", vector="x", size="n", kernel=16, chunk=c).collect()} for c in (1000, 11))
    assert whole == pytest.approx(cut) and [whole[i] for i in range(150)] == pytest.approx(plain_novelty(x, 16))


def test_prominent_peaks_of_random_series():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.integers(0, int(rng.integers(2, 12)), int(rng.integers(4, 60))).astype(float)
        peaks = s.local_peaks(x)
        assert peaks.tolist() == plain_peaks(x, 1, -1)
        for distance, bound in ((1, 2.0), (4, 1.0), (7, 3.0)):
            near = s.spaced(x, peaks, distance)
            assert near[s.prominence(x, near) >= bound].tolist() == plain_peaks(x, distance, bound)
