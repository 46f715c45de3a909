"""Lines t(n) = u + n * period through brackets lo <= t(n) <= hi.

In the plane of (period, u) the lines that meet all brackets are a convex polygon: u lies between the greatest lo - n * period
and the least hi - n * period. Only the upper hull of the points (n, lo) and the lower hull of (n, hi) bound it, and the hull of
a union is the hull of the parts' hulls. Each batch of rows therefore sends one row a key: its two hulls and the sums that a
least-squares fit needs. That is one shuffle of hulls, however many brackets a key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.windows import dealt, running

PART_ROWS = 100_000
FOUND = ("slack", "period_low", "period_high", "u", "period")


def hull(points: np.ndarray, upper: bool) -> np.ndarray:
    """Points (n, v) on the upper or lower hull, by n; of equal n only the outermost counts."""
    sign = -1.0 if upper else 1.0
    points = points[np.lexsort((sign * points[:, 1], points[:, 0]))]
    points = points[np.append(True, np.diff(points[:, 0]) > 0)]
    while len(points) > 2:
        run, rise = np.diff(points[:, 0]), np.diff(points[:, 1])
        bent = sign * (rise[1:] * run[:-1] - rise[:-1] * run[1:]) > 0
        if bent.all():
            break
        # points that do not bend the right way go, but never two neighbours in one round: one may save the other
        drop = np.flatnonzero(~bent) + 1
        drop = drop[np.append(True, np.diff(drop) > 1)] if len(drop) > 1 else drop
        points = np.delete(points, drop, axis=0)
    return points


def _bounds(low: np.ndarray, high: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest u for each period."""
    return (low[:, 1] - np.multiply.outer(period, low[:, 0])).max(1), (high[:, 1] - np.multiply.outer(period, high[:, 0])).min(1)


def polygon(low: np.ndarray, high: np.ndarray) -> tuple[float, np.ndarray]:
    """The least widening of all brackets that leaves a line, and the corners (period, u) of the lines then left.

    The room for u is a concave function of the period, straight between the slopes of the hulls' edges.
    """
    slopes = np.concatenate([np.diff(x[:, 1]) / np.diff(x[:, 0]) for x in (low, high)])
    knots = np.unique(slopes)
    least, most = _bounds(low, high, knots)
    # beyond the outermost slopes the room falls by the brackets' whole width in n for each unit of period
    far = (abs(most - least).max() + 1) / (low[-1, 0] - low[0, 0])
    knots = np.concatenate([[knots[0] - far], knots, [knots[-1] + far]])
    least, most = _bounds(low, high, knots)
    room = most - least
    slack = max(0.0, -float(room.max()) / 2)
    room = room + 2 * slack
    room[np.argmax(room)] = max(room.max(), 0.0)
    inside = np.flatnonzero(room >= 0)
    ends = []
    for a, b in ((inside[0], inside[0] - 1), (inside[-1], inside[-1] + 1)):
        share = room[a] / (room[a] - room[b]) if room[a] > room[b] else 0.0
        ends.append(knots[a] + share * (knots[b] - knots[a]))
    period = np.unique(np.concatenate([[ends[0]], knots[inside], [ends[1]]]))
    least, most = _bounds(low, high, period)
    corners = np.concatenate([np.stack([period, least - slack], 1), np.stack([period, most + slack], 1)[::-1]])
    return slack, corners


def nearest_line(corners: np.ndarray, sums: np.ndarray) -> tuple[float, float]:
    """(u, period) of the line in the polygon with the least squares to the midpoints: sums are n, of x, xx, y and xy."""
    n, x, xx, y, xy = sums
    h, g = np.array([[xx, x], [x, n]]), np.array([xy, y])
    after = np.roll(corners, -1, axis=0)
    area = (corners[:, 0] * after[:, 1] - corners[:, 1] * after[:, 0]).sum()
    if area > 1e-9 * np.ptp(corners[:, 1]) and n * xx - x * x > 1e-12 * max(n * xx, 1.0):
        free = np.linalg.solve(h, g)
        edge, to = np.roll(corners, -1, axis=0) - corners, free - corners
        side = edge[:, 0] * to[:, 1] - edge[:, 1] * to[:, 0]
        if (side >= -1e-9 * area).all():  # corners may coincide but for their last digits
            return float(free[1]), float(free[0])
    # else on an edge: the least point of a parabola between its ends
    edge = np.roll(corners, -1, axis=0) - corners
    bend, fall = np.einsum("ij,jk,ik->i", edge, h, edge), np.einsum("ij,ij->i", edge, g - corners @ h)
    at = corners + np.clip(np.where(bend > 0, fall / np.where(bend > 0, bend, 1.0), 0.0), 0, 1)[:, None] * edge
    best = at[np.argmin(np.einsum("ij,jk,ik->i", at, h, at) - 2 * at @ g)]
    return float(best[1]), float(best[0])


def _parts(batches: Iterator[pa.RecordBatch], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row a key of each PART_ROWS rows or so: hulls and sums."""
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= PART_ROWS:
            yield _part(waiting, kind)
            waiting, rows = [], 0
    if rows:
        yield _part(waiting, kind)


def _part(batches: list[pa.RecordBatch], kind: pa.Schema) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    keys = table.column("_key").combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    code = keys.dictionary_encode().indices.fill_null(-1).to_numpy()
    n, lo, hi = (table.column(c).to_numpy() for c in ("_n", "_lo", "_hi"))
    order = np.argsort(code, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
    first, low, high, sums = [], [], [], []
    for own in np.split(order, cut[1:]):
        x, mid = n[own], (lo[own] + hi[own]) / 2
        first.append(own[0])
        low.append(hull(np.stack([x, lo[own]], 1), True).ravel())
        high.append(hull(np.stack([x, hi[own]], 1), False).ravel())
        sums.append([len(own), x.sum(), x @ x, mid.sum(), x @ mid])
    lists = [pa.array(v, pa.list_(pa.float64())) for v in (low, high, sums)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(first, pa.int64())), *lists], schema=kind)


def feasible_lines(brackets: DataFrame, *, key: str, n: str, lo: str, hi: str) -> DataFrame:
    """Per key: brackets, slack (the least widening that leaves a line, 0 if none is needed), the least and greatest period
    of the lines left, and u and period of the one nearest to the brackets' middles in least squares.

    A key with a single n has no least or greatest period; its slack and line are null as well. Brackets with nulls are left out.
    """
    rows = brackets.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(new) for c, new in ((n, "_n"), (lo, "_lo"), (hi, "_hi"))]).where("_n is not null and _lo is not null and _hi is not null")
    kind = dict(rows.dtypes)["_key"]
    part = f"_key {kind}, low array<double>, high array<double>, sums array<double>"
    arrow = pa.schema([("_key", _arrow(kind)), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64()))])
    parts = rows.mapInArrow(lambda b: _parts(b, arrow), part)
    merged = parts.groupBy("_key").agg(F.flatten(F.collect_list("low")).alias("low"), F.flatten(F.collect_list("high")).alias("high"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(5)])
    found = _solved(F.col("low"), F.col("high"), F.array(*[F.col(f"s{i}") for i in range(5)]))
    return merged.select(F.col("_key").alias(key), F.col("s0").cast("long").alias("brackets"), found.alias("f")).select(key, "brackets", "f.*")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[kind]


def _solved(low: Column, high: Column, sums: Column) -> Column:
    @F.arrow_udf("struct<" + ", ".join(f"{c}: double" for c in FOUND) + ">")
    def run(a: pa.Array, b: pa.Array, s: pa.Array) -> pa.Array:
        out = []
        for x, y, z in zip(a.to_pylist(), b.to_pylist(), s.to_pylist()):
            lows, highs = (hull(np.array(v).reshape(-1, 2), up) for v, up in ((x, True), (y, False)))
            if len(lows) < 2 or len(highs) < 2:
                out.append(dict.fromkeys(FOUND))
                continue
            # about the middle of n and of the brackets, so that corners keep their digits
            x0, y0 = z[1] / z[0], z[3] / z[0]
            slack, corners = polygon(lows - [x0, y0], highs - [x0, y0])
            u, period = nearest_line(corners, np.array([z[0], 0.0, z[2] - z[1] * x0, 0.0, z[4] - z[1] * y0]))
            out.append(dict(zip(FOUND, (slack, corners[:, 0].min(), corners[:, 0].max(), u + y0 - period * x0, period))))
        return pa.array(out, pa.struct([(c, pa.float64()) for c in FOUND]))

    return run(low, high, sums)


def projected(brackets: DataFrame, *, key: str, index: str, lo: str, hi: str, at: str, period: tuple[float, float]) -> DataFrame:
    """Per key the brackets moved by whole periods to the event `at` and intersected, the nearest first while they still meet.

    A move of k periods widens a bracket by the period's own range. Returns key, low, high and used (brackets that meet; all of
    them where not even the first does).
    """
    k = (F.col(at) - F.col(index)).cast("double")
    ahead = lambda a, b: F.when(k > 0, F.lit(a)).otherwise(F.lit(b))
    moved = brackets.select(key, F.abs(k).alias("_far"), F.col(index).alias("_i"), (F.col(lo) + k * ahead(*period)).alias("_early"), (F.col(hi) + k * ahead(*period[::-1])).alias("_late"), F.lit(1).alias("_one"))
    order = ["_far", "_i"]
    rows = running(dealt(moved, key=[key], by="_far"), key=[key], order=order, sums={"_e": "_early"}, fold="max")
    rows = running(rows, key=[key], order=order, sums={"_l": "_late"}, fold="min")
    met = F.when(F.col("_e") <= F.col("_l"), 1).otherwise(0)
    best = F.max_by(F.struct("_e", "_l"), F.struct(met, *order))
    return rows.groupBy(key).agg(best.alias("b"), F.sum(met).alias("_met"), F.count("*").alias("_all")).select(key, F.col("b._e").alias("low"), F.col("b._l").alias("high"), F.when(F.col("_met") > 0, F.col("_met")).otherwise(F.col("_all")).alias("used"))
