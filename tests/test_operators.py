"""Operators on small tables with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, exprs, special
from tessera.operators import design, fit, folds, joins, robust, series, windows
from tessera.sources.store import ResultStore, narrow, union_rows, wide


def test_asof_directions_and_bounds(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("a", 5), ("b", 7)], "k string, t long")
    right = spark.createDataFrame([("a", 10, 1, 1.0), ("a", 10, 2, 2.0), ("a", 15, 3, 3.0)], "k string, t long, o long, v double")
    run = lambda **o: {(r.k, r.t): r.r_v for r in joins.asof(left, right, key=["k"], time="t", values=["v"], tie="o", width=4, **o).collect()}
    assert run() == {("a", 10): None, ("a", 20): 3.0, ("a", 5): None, ("b", 7): None}
    assert run(strict=False) == {("a", 10): 2.0, ("a", 20): 3.0, ("a", 5): None, ("b", 7): None}
    assert run(forward=True) == {("a", 10): 3.0, ("a", 20): None, ("a", 5): 1.0, ("b", 7): None}
    assert run(forward=True, strict=False) == {("a", 10): 1.0, ("a", 20): None, ("a", 5): 1.0, ("b", 7): None}


def test_limiter_defers_the_latest(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 3, 1, 2.0), ("a", 4, 2, 3.0), ("a", 30, 3, 4.0)], "k string, t long, o long, v double")
    out = sorted((r.at, r.value) for r in folds.limiter(df, key=["k"], time="t", tie="o", value="v", gap=10).collect())
    assert out == [(0, 1.0), (10, 3.0), (30, 4.0)]


def test_islands_and_fill(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, "x", "x", "y", None, "x"])], "k string, t long, v string")
    numbers = [r.island for r in windows.islands(df, key=["k"], order=["t"], same="v").orderBy("t").collect()]
    assert numbers == [1, 2, 2, 3, 4, 5]
    filled = [r.filled for r in windows.fill(df, key=["k"], order=["t"], value="v").orderBy("t").collect()]
    assert filled == ["x", "x", "x", "y", "y", "x"]


def test_robust_scale_falls_back(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 5.0), ("b", 2.0)], "k string, v double")
    found = {r.k: r.scale for r in robust.robust_scale(df, key=["k"], value="v").collect()}
    assert found["b"] == 1.0 and found["a"] == pytest.approx(np.std([1, 1, 1, 5]))


def test_gray_and_sobol(spark):
    df = spark.range(64).select("id", exprs.gray_decode(exprs.gray_encode(F.col("id"))).alias("back"), *[design.sobol_value(F.col("id"), d).alias(f"s{d}") for d in range(3)])
    rows = df.collect()
    assert all(r.id == r.back for r in rows)
    for d in range(3):  # the first 2**k points of a dimension fill its 2**k equal parts
        assert sorted(int(r[f"s{d}"] * 64) for r in rows) == list(range(64))


def test_special_functions():
    assert special.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-9)
    assert special.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert special.fisher_p([0.5]) == pytest.approx(0.5)


def test_array_metrics():
    x = np.linspace(0, 1, 64)
    assert arrays.ssim(x, x)["ssim"] == pytest.approx(1.0)
    t = np.arange(256)
    assert arrays.dynamics(np.sin(2 * math.pi * t / 16))["kind"] == 1.0
    assert arrays.dynamics(np.zeros(64))["kind"] == 0.0
    assert arrays.dynamics(np.random.default_rng(1).standard_normal(256))["kind"] == 3.0
    assert arrays.best_lag(np.sin(t / 7), np.sin((t - 5) / 7))["lag"] == 5.0
    # published test pair of the CIEDE2000 data set
    assert arrays.ciede2000(np.array([50.0, 2.6772, -79.7751]), np.array([50.0, 0.0, -82.7485])) == pytest.approx(2.0425, abs=1e-4)


def test_store_commits_and_pending(spark, tmp_path):
    kind = "program string, firmware string, analyzer string, source string, state_index int, stimulus string, settle_frames int, params array<int>, metrics map<string,double>"
    one = spark.createDataFrame([("p", "1", "a", "hw", 0, "s", 2, [1] * 12, {"m": 1.0})], kind)
    two = spark.createDataFrame([("q", "1", "a", "hw", 0, "s", 2, [2] * 12, {"n": 2.0})], kind)
    store = ResultStore(spark, str(tmp_path / "store"))
    wanted = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", "1")], "program string, firmware string")
    assert store.pending(wanted).count() == 3
    store.put(union_rows([wide(one, ["m"]), wide(two, ["n"])]))
    assert [r.program for r in store.pending(wanted).collect()] == ["r"]
    back = {r.program: r.metrics for r in narrow(store.get().drop("key")).collect()}
    assert back == {"p": {"m": 1.0}, "q": {"n": 2.0}}


@pytest.mark.parametrize("width", [8, 4096])
def test_novelty_of_every_vector(spark, width):
    """One value a vector, by the whole similarity matrix of a label; a change far into a long label is the peak."""
    rng = np.random.default_rng(2)
    rows = [(int(i), "a", (np.array([1.0, 0, 0]) if n < 150 else np.array([0, 1.0, 0])) + 0.05 * rng.standard_normal(3)) for n, i in enumerate(np.sort(rng.choice(1_000, 200, replace=False)))]
    rows += [(1_000 + i, "b", rng.standard_normal(3)) for i in range(3)] + [(2_000, None, np.zeros(3))]
    df = spark.createDataFrame([(i, l, v.tolist()) for i, l, v in rows], "vec_id long, label string, embedding array<double>")
    got = series.checkerboard_novelty(df, key="label", order="vec_id", vector="embedding", width=width).collect()
    assert len(got) == len(rows)
    for label in ("a", "b", None):
        v = np.array([x for _, l, x in rows if l == label])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        own = sorted((r.k, r.vec_id, r.novelty) for r in got if r.label == label)
        assert [r[:2] for r in own] == list(enumerate(i for i, l, _ in rows if l == label))
        assert np.allclose([r[2] for r in own], arrays.novelty(v @ v.T))
        if label == "a":
            assert np.argmax([r[2] for r in own]) == 150


def test_store_replaces_after_a_crash(spark, tmp_path):
    """Data written without a commit, then the same run again: each row once; another key of the program stays apart."""
    rows = spark.createDataFrame([("p", "1", i, 0.5) for i in range(10)] + [("q", "1", 0, 1.0)], "program string, firmware string, state_index int, m double")
    store = ResultStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.put(rows.limit(0))
    keyed = rows.withColumn("key", F.substring(F.sha2(F.concat_ws("\0", "program", F.lit("name_firmware"), "firmware"), 256), 1, 16))
    keyed.write.mode("append").partitionBy("program", "key").parquet(f"{store.path}/data")  # the run that ended early
    assert store.committed().count() == 0
    store.put(rows)
    store.put(rows.where("program = 'p'"))
    assert store.get().count() == 11
    assert {(r.program, r.rows) for r in store.committed().collect()} == {("p", 10), ("q", 1)}
    store.put(rows.where("program = 'p'").limit(3).withColumn("firmware", F.lit("2")))
    assert {(r.program, r["count"]) for r in store.get().groupBy("program").count().collect()} == {("p", 3), ("q", 1)}
    wanted = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "1"), ("r", "1")], "program string, firmware string")
    assert sorted((r.program, r.firmware, r.stored) for r in store.has(wanted).collect()) == [("p", "1", False), ("p", "2", True), ("q", "1", True), ("r", "1", False)]


def test_pair_strength_counts_filled_cells_once(spark):
    """An additive surface has no strength however unevenly its cells are filled, a product has some, a sparse grid none."""
    rng = np.random.default_rng(3)
    rows = [(a, b, n) for a in range(8) for b in range(8) for n in range(int(rng.integers(1, 9)))]
    df = spark.createDataFrame([("k", a, b, 0, float(a // 2 + 10 * (b // 2)), float((a // 2) * (b // 2))) for a, b, _ in rows], "g string, p1 int, p2 int, p3 int, plus double, times double")
    strength = lambda y, frame=df: {(r.a, r.b): r.strength for r in fit.pair_strengths(frame, key=["g"], params=["p1", "p2", "p3"], y=y).collect()}
    assert strength("plus")["p1", "p2"] == pytest.approx(0, abs=1e-12) and strength("times")["p1", "p2"] > 0.1
    assert strength("times")["p1", "p3"] == 0.0
    assert strength("times", df.where("p1 = p2"))["p1", "p2"] == 0.0


def test_pooled_midrank(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 300, 2_000).astype(float).tolist() + [7.0] * 900
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.midrank for r in windows.pooled_midrank(df, value="v", ranges=16).distinct().collect()}
    x = np.array(values)
    assert len(got) == len(set(values)) and all(got[v] == pytest.approx(((x < v).sum() + ((x == v).sum() - 1) / 2) / (len(x) - 1)) for v in got)
    assert [r.midrank for r in windows.pooled_midrank(df.limit(1), value="v").collect()] == [0.5]


def test_exact_medians_of_few_large_keys(spark):
    rng = np.random.default_rng(8)
    values = {"a": rng.normal(size=30_001), "b": rng.integers(0, 9, 20_000).astype(float), "c": np.array([3.0]), "d": np.array([1.0, 4.0]), "e": np.full(5_000, 2.5)}
    df = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("a", None)], "k string, v double").repartition(6)
    got = {r.k: (r.n, r.median) for r in robust.exact_median(df, key=["k"], value="v").collect()}
    assert got == {k: (len(x), pytest.approx(float(np.median(x)))) for k, x in values.items()}
    both = [{r.k: (r.n, r.median, r.scale) for r in robust.robust_scale(df, key=["k"], value="v", dealt=d).collect()} for d in (True, False)]
    assert both[0].keys() == both[1].keys() and all(both[0][k] == pytest.approx(both[1][k]) for k in both[0])


def test_counters_over_dealt_ranges(spark):
    rng = np.random.default_rng(9)
    rows = [("k", int(i), int(n)) for i, n in zip(np.sort(rng.choice(5_000, 400, replace=False)), rng.integers(0, 25, 400))]
    df = spark.createDataFrame(rows, "k string, o long, n long")
    got = {r.o: r.changes for r in folds.change_counter(df, key=["k"], order="o", rate="n", one=10, width=64).collect()}
    total = 0
    for _, o, n in rows:
        assert got[o] == (total + n) // 10 - total // 10
        total += n
    counts = {r.o: r.in_span for r in folds.sliding_count(df, key=["k"], time="o", span=50, spans=3).collect()}
    assert counts == {o: sum(o - 50 < p <= o for _, p, _ in rows) for _, o, _ in rows}
