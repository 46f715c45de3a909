"""Programs for the runs of a score: least-cost routes in which no program follows itself, over a few programs chosen one by one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _other_least(totals: np.ndarray) -> np.ndarray:
    """For each place of the last axis the least of all other places."""
    if totals.shape[-1] == 1:
        return totals
    two = np.partition(totals, 1, axis=-1)[..., :2]
    first = np.arange(totals.shape[-1]) == totals.argmin(-1)[..., None]
    return np.where(first, two[..., 1:], two[..., :1])


def route_costs(cost: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Least total of a route through the runs (rows of cost) for each set of programs (a row of column numbers), all sets at
    once. A lone program plays throughout."""
    totals = cost[0][sets]
    for row in cost[1:]:
        totals = _other_least(totals) + row[sets]
    return totals.min(1)


def route(cost: np.ndarray) -> np.ndarray:
    """The least-cost route itself; of equal ones that with the smaller program later on."""
    totals = [cost[0]]
    for row in cost[1:]:
        totals.append(_other_least(totals[-1]) + row)
    at = int(totals[-1].argmin())
    path = [at]
    for before in totals[-2::-1]:
        if cost.shape[1] > 1:
            before = before.copy()
            before[at] = np.inf
            at = int(before.argmin())
        path.append(at)
    return np.array(path[::-1])


def select(cost: np.ndarray, passes: int) -> list[int]:
    """Programs kept one at a time, each the one with which the best route over those kept is cheapest (the first on a tie)."""
    chosen: list[int] = []
    for _ in range(min(passes, cost.shape[1])):
        rest = [p for p in range(cost.shape[1]) if p not in chosen]
        chosen.append(rest[int(route_costs(cost, np.array([[*chosen, p] for p in rest])).argmin())])
    return chosen


def assign(costs: DataFrame, *, key: str, run: str, state: str, cost: str, states: list[str], passes: int | None = None) -> DataFrame:
    """key, run, state, step_cost and total: the state of each run on the key's cheapest route.

    With `passes`, only so many states are used, chosen greedily per key. The states are a given list; their order breaks ties.
    A state without a cost in a run cannot be taken there. Costs are gathered once, one row a key, which has to fit a row; every
    selection step works on that row.
    """
    known = costs.where(F.col(state).isin(states) & F.col(cost).isNotNull())
    place = F.array_position(F.array(*[F.lit(s) for s in states]), F.col(state)) - 1
    rows = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(run).alias("run"), place.cast("int").alias("state"), F.col(cost).cast("double").alias("cost")))).alias("_c"))
    found = rows.select(key, F.inline(_assigned(F.col("_c.run"), F.col("_c.state"), F.col("_c.cost"), len(states), passes)))
    return found.select(key, F.col("run").alias(run), F.get(F.array(*[F.lit(s) for s in states]), F.col("state")).alias(state), "step_cost", "total")


def _assigned(run: Column, state: Column, cost: Column, states: int, passes: int | None) -> Column:
    @F.arrow_udf("array<struct<run: bigint, state: int, step_cost: double, total: double>>")
    def solve(runs: pa.Array, at: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for r, s, v in zip(runs.to_pylist(), at.to_pylist(), values.to_pylist()):
            names, row = np.unique(r, return_inverse=True)
            matrix = np.full((len(names), states), np.inf)
            np.minimum.at(matrix, (row, np.array(s)), v)
            chosen = np.array(select(matrix, passes) if passes else range(states))
            path = chosen[route(matrix[:, chosen])]
            own = matrix[np.arange(len(names)), path]
            total = float(own.sum())
            out.append([{"run": int(n), "state": int(p), "step_cost": float(c), "total": total} for n, p, c in zip(names, path, own)])
        return pa.array(out, pa.list_(pa.struct([("run", pa.int64()), ("state", pa.int32()), ("step_cost", pa.float64()), ("total", pa.float64())])))

    return solve(run, state, cost)


def gate_writes(writes: DataFrame, *, key: str, time: str, tie: str, param: str, value: str, live: dict[int, list[tuple[int, int, int]]], revivals: dict[int, list[list[tuple[int, int]]]]) -> DataFrame:
    """Writes whose parameter is live where they land; a dead one comes after the moves that revive it, or is refused.

    live: for a gated parameter the conditions (gate, least, most) on the states of other parameters that must all hold.
    revivals: its offered moves, each a list of (parameter, value); the first one under which it is live is written just before
    it. A write that changes nothing passes. All states start at 0.

    An ordered fold with the states as its map. A write yields a code (-1 refused, 0 as it is, m after the m-th offer), so what
    the fold carries does not grow with the rows. Returns key, at, tie, param, value, place (moves from 0 on, then the write) and
    paired. A key's writes have to fit a row.
    """
    item = F.struct(F.col(time).alias("t"), F.col(tie).alias("o"), F.col(param).cast("int").alias("p"), F.col(value).cast("long").alias("v"))
    rows = writes.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_w"))
    coded = rows.select(key, "_w", _gate_codes(F.col("_w.p"), F.col("_w.v"), live, revivals).alias("_c"))
    each = coded.select(key, F.explode(F.arrays_zip("_w", "_c")).alias("z")).select(key, F.col("z._w.t").alias("at"), F.col("z._w.o").alias(tie), F.struct(F.col("z._w.p").alias("param"), F.col("z._w.v").alias("value")).alias("own"), F.col("z._c").alias("code")).where("code >= 0")
    moves = F.lit(None).cast("array<struct<param: int, value: bigint>>")
    for p, offers in revivals.items():
        for m, offer in enumerate(offers, 1):
            listed = F.array(*[F.struct(F.lit(g).alias("param"), F.lit(w).cast("long").alias("value")) for g, w in offer])
            moves = F.when((F.col("own.param") == p) & (F.col("code") == m), listed).otherwise(moves)
    written = F.when(moves.isNull(), F.array("own")).otherwise(F.concat(moves, F.array("own")))
    return each.select(key, "at", tie, F.posexplode(written).alias("place", "w"), (F.col("code") > 0).alias("paired")).select(key, "at", tie, "w.param", "w.value", "place", "paired")


def _gate_codes(param: Column, value: Column, live: dict, revivals: dict) -> Column:
    def holds(state: dict[int, int], p: int) -> bool:
        return all(least <= state.get(g, 0) <= most for g, least, most in live.get(p, ()))

    @F.arrow_udf("array<int>")
    def run(ps: pa.Array, vs: pa.Array) -> pa.Array:
        out = []
        for params, values in zip(ps.to_pylist(), vs.to_pylist()):
            state: dict[int, int] = {}
            codes = []
            for p, v in zip(params, values):
                code = 0
                if state.get(p, 0) != v and not holds(state, p):
                    code = next((m for m, offer in enumerate(revivals.get(p, ()), 1) if holds(state | dict(offer), p)), -1)
                if code > 0:
                    state.update(revivals[p][code - 1])
                if code >= 0:
                    state[p] = v
                codes.append(code)
            out.append(codes)
        return pa.array(out, pa.list_(pa.int32()))

    return run(param, value)
