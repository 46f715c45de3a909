"""Assignment of programs against all routes and all selections; gated writes against a plain loop."""

from itertools import product

import numpy as np
import pytest

from tessera.operators import assign


def all_routes(cost, programs):
    """Cheapest route over the programs, none twice running unless it is the only one; by trying every route."""
    runs = len(cost)
    routes = [r for r in product(programs, repeat=runs) if len(programs) == 1 or all(a != b for a, b in zip(r, r[1:]))]
    return min(sum(cost[i][p] for i, p in enumerate(r)) for r in routes)


def greedy(cost, passes):
    kept = []
    for _ in range(passes):
        kept.append(min((p for p in range(len(cost[0])) if p not in kept), key=lambda p: all_routes(cost, [*kept, p])))
    return kept


@pytest.mark.parametrize("passes", [1, 2, 3, None])
def test_assign_equals_all_routes(spark, passes):
    rng = np.random.default_rng(3)
    names, rows, held = list("abcd"), [], {}
    for key in range(30):
        cost = rng.integers(0, 20, (int(rng.integers(1, 6)), 4))
        rows += [(key, 10 * i, names[p], float(cost[i][p])) for i in range(len(cost)) for p in range(4)]
        kept = greedy(cost, passes) if passes else range(4)
        held[key] = all_routes(cost, list(kept)), {names[p] for p in kept}
    rows += [(0, 0, "z", -9.0), (0, 0, "a", None)]
    df = spark.createDataFrame(rows, "key long, run long, program string, cost double").repartition(5)
    made = assign.assign(df, key="key", run="run", state="program", cost="cost", states=names, passes=passes).collect()
    for key, (total, kept) in held.items():
        own = sorted((r.run, r.program, r.step_cost, r.total) for r in made if r.key == key)
        assert sum(c for *_, c, _ in own) == total and {t for *_, t in own} == {total}
        assert {p for _, p, *_ in own} <= kept
        assert passes == 1 or all(a[1] != b[1] for a, b in zip(own, own[1:]))
    assert assign.assign(df.limit(0), key="key", run="run", state="program", cost="cost", states=names).collect() == []


def test_writes_are_gated(spark):
    rules = {"live": {1: [(7, 512, 1023)], 2: [(7, 0, 511), (3, 512, 1023)]}, "revivals": {1: [[(7, 1023)]], 2: [[(7, 0)]]}}
    rows = [(1, 0, 1, 100), (1, 1, 1, 200), (1, 2, 2, 50), (1, 3, 7, 0), (2, 0, 1, 0), (3, 0, 3, 600), (3, 1, 7, 700), (3, 2, 2, 5), (3, 3, 2, 6), (3, 4, 1, 9)]
    df = spark.createDataFrame(rows, "key long, t long, p int, v long")
    made = assign.gate_writes(df, key="key", time="t", tie="t", param="p", value="v", **rules)
    out = {}
    for r in sorted(made.collect(), key=lambda r: (r.key, r.at, r.place)):
        out.setdefault(r.key, []).append((r.at, r.param, r.value, r.paired))
    assert out[1] == [(0, 7, 1023, True), (0, 1, 100, True), (1, 1, 200, False), (3, 7, 0, False)]
    assert out[2] == [(0, 1, 0, False)]
    assert out[3] == [(0, 3, 600, False), (1, 7, 700, False), (2, 7, 0, True), (2, 2, 5, True), (3, 2, 6, False), (4, 7, 1023, True), (4, 1, 9, True)]


def test_the_first_offer_that_revives_is_taken(spark):
    df = spark.createDataFrame([(1, 0, 5, 1), (1, 1, 5, 2)], "key long, t long, p int, v long")
    offers = {5: [[(2, 9)], [(2, 3), (4, 1)]]}
    made = assign.gate_writes(df, key="key", time="t", tie="t", param="p", value="v", live={5: [(2, 1, 5)]}, revivals=offers)
    assert sorted((r.at, r.place, r.param, r.value) for r in made.collect()) == [(0, 0, 2, 3), (0, 1, 4, 1), (0, 2, 5, 1), (1, 0, 5, 2)]
