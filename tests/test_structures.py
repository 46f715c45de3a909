"""Refinement and isomorphism, sampling and the principal response against plain versions."""

from collections import Counter

import numpy as np
import pytest

from tessera.operators import components, graphs, markov
from tessera.plans import catalogue


def plain_classes(nodes, edges):
    colour = {v: (lab,) for v, lab in nodes}
    while True:
        ways = {v: [] for v in colour}
        for s, d, lab in edges:
            ways[d].append(("in", lab, colour[s]))
            ways[s].append(("out", lab, colour[d]))
        new = {v: (c, tuple(sorted(ways[v]))) for v, c in colour.items()}
        number = {c: i for i, c in enumerate(sorted(set(new.values())))}
        new = {v: (number[c],) for v, c in new.items()}
        if len(set(new.values())) == len(set(colour.values())):
            return {v: min(u for u in new if new[u] == new[v]) for v in new}
        colour = new


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, "node long, label string"), spark.createDataFrame(edges, "src long, dst long, label string")


@pytest.mark.parametrize("seed", range(3))
def test_classes_equal_exact_refinement(spark, seed):
    rng = np.random.default_rng(seed)
    n = 40
    nodes = [(i, rng.choice(["a", "b"])) for i in range(n)]
    edges = [(int(a), int(b), "x" if seed else rng.choice(["x", "y"])) for a, b in rng.integers(0, n, (30 + 10 * seed, 2))]
    edges += edges[:3]  # a repeated connection counts twice
    made = graphs.classes(*frames(spark, nodes, edges)).collect()
    held = plain_classes(nodes, edges)
    assert {r.node: r["class"] for r in made} == held
    assert {r.node: r.size for r in made} == {v: sum(c == k for c in held.values()) for v, k in held.items()}


def test_isomorphic(spark):
    rng = np.random.default_rng(9)
    n = 30
    nodes = [(i, str(rng.integers(0, 3))) for i in range(n)]
    edges = [(i, int(rng.integers(0, i)), str(rng.integers(0, 4))) for i in range(1, n)]
    to = rng.permutation(n)

    def test(nodes_b, edges_b):
        a, b = frames(spark, nodes, edges), frames(spark, nodes_b, edges_b)
        both = [x.selectExpr("0 as graph", "*").unionByName(y.selectExpr("1 as graph", "*")) for x, y in zip(a, b)]
        return graphs.isomorphic(*both).collect()

    moved = [(int(to[i]), lab) for i, lab in nodes], [(int(to[a]), int(to[b]), lab) for a, b, lab in edges]
    same = test(*moved)
    assert len(same) == 1 and same[0].nodes == n and same[0].isomorphic == (same[0].colours == n or same[0].isomorphic)
    assert plain_classes(nodes, edges) and test(nodes, edges)[0].isomorphic
    assert not test(moved[0], moved[1][:-1])[0].isomorphic
    assert not test(moved[0], [*moved[1][:-1], (moved[1][-1][0], moved[1][-1][1], "other")])[0].isomorphic
    # two triangles and a hexagon have equal colours but are not the same
    ring = lambda ids: [(a, b, "") for a, b in zip(ids, ids[1:] + ids[:1])]
    flat = [(i, "") for i in range(6)]
    six, threes = frames(spark, flat, ring([0, 1, 2, 3, 4, 5])), frames(spark, flat, ring([0, 1, 2]) + ring([3, 4, 5]))
    both = [x.selectExpr("0 as graph", "*").unionByName(y.selectExpr("1 as graph", "*")) for x, y in zip(six, threes)]
    answer = graphs.isomorphic(*both).first()
    assert answer.colours == 1 and not answer.isomorphic


def test_draws_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, int(s)) for k in (1, 2) for i, s in enumerate(rng.choice(3, 400, p=[0.6, 0.3, 0.1]))] + [(3, 0, 1)]
    df = spark.createDataFrame(rows, "key long, i long, symbol int")
    made = []
    for parts in (1, 13):
        tables = markov.contexts(df.repartition(parts), key="key", order="i", bins=3, depth=2)
        made.append(sorted(map(tuple, markov.sample(tables, key="key", steps=3000, bins=3, depth=2, seed=5).collect())))
    assert made[0] == made[1] and len(made[0]) == 9000
    held = Counter()
    for k in (1, 2):
        own = [s for key, _, s in rows if key == k]
        for a, b, c in zip(own, own[1:], own[2:]):
            held[k, 3 * b + a, c] += 1
    found = {(r.key, r.context): r.counts for r in tables.collect()}
    assert {(k, c, s): n for (k, c), row in found.items() if c is not None for s, n in enumerate(row) if n} == dict(held)
    drawn = Counter()
    own = [s for k, _, s in made[0] if k == 1]
    for a, b, c in zip(own, own[1:], own[2:]):
        drawn[3 * b + a, c] += 1
    for (k, context), row in found.items():
        total = sum(drawn[context, s] for s in range(3)) if k == 1 and context is not None else 0
        for s in range(3 if total > 100 else 0):
            p = (row[s] + 1) / (sum(row) + 3)
            assert abs(drawn[context, s] / total - p) < 5 * np.sqrt(p * (1 - p) / total)


def test_principal_response_equals_svd(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    x = (x - x.mean(0)) / x.std(0)
    left, size, right = np.linalg.svd(x, full_matrices=False)
    held = left[:, 0] * size[0] * np.sign(right[0, np.abs(right[0]).argmax()])
    made = {r.vec_id: r.response for r in catalogue.queries()["label_response"](spark, "/root/testdata/sf0.01").collect()}
    assert [made[r.vec_id] for r in rows] == pytest.approx(held, abs=1e-5)
    odd = spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, None), (4, [float("nan"), 1.0]), (5, [6.0, 5.0])], "i long, x array<double>")
    got = {r.i: r.response for r in components.principal_response(odd, "x").collect()}
    assert got[3] is None and got[4] is None and got[1] < got[2] < got[5] and sum(got[i] for i in (1, 2, 5)) == pytest.approx(0)
    assert [r.response for r in components.principal_response(odd.where("i = 3"), "x").collect()] == [None]
