"""Near-duplicate embeddings by collision counting on sorted one-dimensional projections.

Every round draws random directions. One gives a value v, the others give sign bits that form a bucket key. Rows are sorted
by (key, v), and two vectors collide in the round if they share the key and lie in each other's window |v - v'| <= width.
(Plain one-dimensional windows hold a fixed share of all pairs whatever their number, so the sort key is made longer by the
sign bits, a few less than the logarithm of the number of vectors.) Each vector's collisions with each other are counted
over all rounds, and pairs with at least `count` collisions are verified by their cosine in double precision.

The number of rounds is calibrated: for two vectors exactly at the threshold, the chance of a collision follows from
the angle and the width, and the rounds are the fewest for which the count reaches `count` with probability `recall`.
Pairs above the threshold collide more often.

Only distinct vectors are compared; copies are counted by their multiplicity. A pair is verified in the round of its
`count`-th collision and nowhere else: a task knows both vectors, so it derives their earlier rounds itself, and links
are counted once without any exchange of pairs. A bucket with more than `block` vectors is cut into blocks that meet two
by two in tasks of their own, so no task holds more than two blocks. Tasks return link counts and the edges of a spanning
forest, not pairs.

Defined cases: a vector that is null, empty or zero, or has a null or non-finite component, or whose length differs from
the table's most common one, links with nothing and is a component of its own. Equal vectors link with each other. Rows that repeat an id are vectors of their own; a null id is never the
smallest of a component unless alone. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored
from tessera.llm._graph import connected_components, forest

COUNT = 2
RECALL = 0.98
WIDTH = 2.0
BLOCK = 1_024
POOL = 192
PAIRS = 50_000


class Projections:
    """Random directions of all rounds: a pool of sign bits, of which every round's key takes its own few, and a value each."""

    def __init__(self, dim: int, bits: int, rounds: int, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.signs = rng.standard_normal((dim, POOL))
        self.values = rng.standard_normal((dim, rounds))
        self.pick = np.zeros((POOL, rounds))
        for r in range(rounds):
            self.pick[rng.choice(POOL, bits, replace=False), r] = 2.0 ** np.arange(bits)

    def of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and values of unit vectors in each round: (n, rounds)."""
        return ((unit @ self.signs > 0) @ self.pick).astype(np.int64), unit @ self.values


@lru_cache(maxsize=2)
def projections(dim: int, bits: int, rounds: int) -> Projections:
    return Projections(dim, bits, rounds)


def recall_of(threshold: float, bits: int, width: float, rounds: int, count: int) -> float:
    """Chance that two unit vectors with cosine `threshold` collide at least `count` times.

    Given how many of the pool's signs differ, the rounds are independent.
    """
    differ, window = math.acos(threshold) / math.pi, math.erf(width / math.sqrt(2))
    total = 0.0
    for f in range(POOL - bits + 1):
        share = math.comb(POOL, f) * differ**f * (1 - differ) ** (POOL - f)
        p = window * math.comb(POOL - f, bits) / math.comb(POOL, bits)
        total += share * (1 - sum(math.comb(rounds, k) * p**k * (1 - p) ** (rounds - k) for k in range(count)))
    return total


def rounds_needed(threshold: float, bits: int, width: float, count: int, recall: float) -> int:
    """Fewest rounds that reach the recall."""
    low, high = count, 2 * count
    while recall_of(threshold, bits, width, high, count) < recall:
        low, high = high, 2 * high
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if recall_of(threshold, bits, width, mid, count) >= recall else (mid + 1, high)
    return low


def compare(task: np.ndarray, rnd: np.ndarray, one: np.ndarray, first: np.ndarray, node: np.ndarray, copies: np.ndarray, v: np.ndarray, p: Projections, reach: float, count: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Link counts (nodes, counts) and forest edges (a, b) of whole tasks; rows carry the number of their task and its round.

    A task with one block compares all its rows, one with two compares rows of the first with rows of the second.
    """
    keys, values = p.of(v)
    own = values[np.arange(len(v)), rnd]
    order = np.lexsort((own, task))
    task, rnd, one, first, node, copies, v, keys, values, own = (x[order] for x in (task, rnd, one, first, node, copies, v, keys, values, own))
    # query-centred windows: the rows after row i of its task whose value is within reach
    shift = (own - own.min()) if len(own) else own
    step = (shift.max() if len(own) else 0) + 2 * reach + 1
    place = shift + task * step
    last = np.searchsorted(place, place + reach, "right")
    n_after = np.maximum(last - np.arange(len(v)) - 1, 0)
    links, edges = np.zeros(len(v), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    ends = np.cumsum(n_after)
    columns = np.arange(keys.shape[1])
    at = 0
    while at < len(v):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = n_after[at:stop]
        a = np.repeat(np.arange(at, stop), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        at = stop
        apart = one[a] | (first[a] != first[b])
        a, b = a[apart], b[apart]
        earlier = (keys[a] == keys[b]) & (columns < rnd[a][:, None]) & (np.abs(values[a] - values[b]) <= reach)
        now = earlier.sum(1) == count - 1
        a, b = a[now], b[now]
        near = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
        a, b = a[near], b[near]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        edges.append(forest(node[a], node[b]))
    x, y = forest(*(np.concatenate(e) for e in zip(*edges)))
    some = np.flatnonzero(links)
    return node[some], links[some], x, y


def link_components(vectors: DataFrame, *, threshold: float = 0.9, embedding: str = "embedding", vec_id: str = "vec_id", bits: int | None = None, count: int = COUNT, recall: float = RECALL, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept. width is in units of the distance of two vectors at the threshold."""
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    x = F.col(embedding).cast(kind)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
    size = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim = size["d"] if size else 1
    usable = (F.size("x") == dim) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    as_text = F.concat_ws(",", F.transform("x", lambda c: F.when(c == 0, F.lit("0")).otherwise(c.cast("string"))))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("x", F.when(F.col("usable"), F.col("x")))
    rows = stored(rows.withColumn("key", F.when(F.col("usable"), F.sha2(as_text, 256))), "embeddings")
    distinct = rows.where("usable").groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.min(F.struct("x")).alias("s")).select("key", "copies", "least", F.col("s.x").alias("x"))
    distinct = stored(distinct.withColumn("node", F.xxhash64("key")), "embeddings-distinct")
    n = distinct.count()
    # a bit more doubles the buckets and takes a fifth more rounds: best where pairs cost a quarter of the rows dealt
    bits = max(2, round(math.log2(max(n, 16))) - 5) if bits is None else bits
    rounds = rounds_needed(threshold, bits, width, count, recall)
    reach = width * math.sqrt(2 - 2 * threshold)

    def unit_of(column: pa.Array) -> np.ndarray:
        v = np.asarray(column.flatten()).reshape(-1, dim).astype(np.float64)
        v = v / np.abs(v).max(axis=1, keepdims=True)  # squares then neither overflow nor vanish
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = projections(dim, bits, rounds)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys, _ = p.of(unit_of(part.column(1)))
                row = pa.array(np.repeat(np.arange(len(keys)), rounds))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(rounds, dtype=np.int32), len(keys))), pa.array(keys.ravel()), *(part.column(c).take(row) for c in (0, 1, 2))], ["round", "bucket", "node", "x", "copies"])

    # sizes come from the keys alone; the vectors are dealt once
    dealt = distinct.select("node", "x", "copies").mapInArrow(deal, f"round int, bucket long, node long, x {kind}, copies long")
    sizes = stored(dealt.groupBy("round", "bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("k", F.ceil(F.col("n") / block)), "embeddings-buckets")
    cut = dealt.join(sizes, ["round", "bucket"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("k"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    tasks = cut.select("round", "bucket", F.least("i", "with").alias("i"), F.greatest("i", "with").alias("j"), (F.col("i") <= F.col("with")).alias("first"), "node", "copies", "x")
    task_key = ["round", "bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, kept = projections(dim, bits, rounds), []

        def of(table: pa.Table, task: np.ndarray) -> pa.RecordBatch:
            column = lambda c: np.asarray(table.column(c))
            x = table.column("x").combine_chunks()
            node, links, a, b = compare(task, column("round"), column("i") == column("j"), column("first"), column("node"), column("copies"), unit_of(x), p, reach, count, threshold)
            # link counts and edges in one table: a count stands at (node, node), an edge has none
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, a])), pa.array(np.concatenate([node, b])), pa.array(np.concatenate([links, np.zeros(len(a), np.int64)]))], ["a", "b", "links"])

        def numbered(table: pa.Table) -> np.ndarray:
            new = np.zeros(len(table), bool)
            for c in task_key:
                k = np.asarray(table.column(c))
                new[1:] |= k[1:] != k[:-1]
            return np.cumsum(new)

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                kept.append(batch.slice(at, 4096))
                table = pa.Table.from_batches(kept)
                task = numbered(table)
                whole = int(np.searchsorted(task, task[-1])) if len(task) else 0
                if whole:
                    yield of(table.slice(0, whole), task[:whole])
                kept = table.slice(whole).to_batches()
        if kept:
            table = pa.Table.from_batches(kept)
            yield of(table, numbered(table))

    dealt_tasks = tasks.repartition(*task_key).sortWithinPartitions(*task_key)
    found = stored(dealt_tasks.mapInArrow(run, "a long, b long, links long"), "embeddings-links")
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("a <> b"), "a", "b")
    classes = distinct.select("key", "node", "copies", "least").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(classes, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
