"""Context tables of symbol sequences and seeded sequences drawn from them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.windows import before, dealt

DRAW = 1 << 32


def symbols(rows: DataFrame, *, key: str, value: str, bins: int) -> DataFrame:
    """rows with `symbol`: the bin of a value among equal ones over its key's range, 0 where all values are one."""
    ends = rows.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    at = F.least(F.lit(bins - 1), F.floor(share * bins).cast("int"))
    return rows.join(ends, key).withColumn("symbol", F.when(F.col("_hi") > F.col("_lo"), at).otherwise(F.lit(0))).drop("_lo", "_hi")


def contexts(rows: DataFrame, *, key: str, order: str, bins: int, depth: int) -> DataFrame:
    """key, context and counts: how often each symbol follows a context of `depth` symbols, and over all (a null context).

    A context is a number, its latest symbol counting most. Rows have `symbol`; the order column is a number without repeats in
    a key. Lags go from range to range, so a key is many tasks; a key's table has at most bins ** depth rows.
    """
    seen = dealt(rows.select(key, F.col(order).alias("_o"), "symbol"), key=[key], by="_o").withColumn("_h", F.array("symbol"))
    for _ in range(depth):
        seen = before(seen, key=[key], order=["_o"], value="_h", name="_p").withColumn("_h", F.concat(F.array("symbol"), F.coalesce("_p", F.array().cast("array<int>")))).drop("_p")
    past = F.slice("_h", 2, depth)
    code = F.aggregate(F.reverse(past), F.lit(0).cast("long"), lambda a, x: F.floor(a / bins) + x * bins ** (depth - 1))
    flags = F.when(F.size("_h") > depth, F.array(code, F.lit(None).cast("long"))).otherwise(F.array(F.lit(None).cast("long")))
    each = seen.select(key, F.explode(flags).alias("context"), "symbol")
    return each.groupBy(key, "context").agg(F.array(*[F.count_if(F.col("symbol") == s) for s in range(bins)]).alias("counts"))


def sample(tables: DataFrame, *, key: str, steps: int, bins: int, depth: int, seed: int) -> DataFrame:
    """key, step (from 0) and symbol: a sequence of `steps` symbols drawn from each key's context table.

    A symbol is drawn by its count plus one, in the table of the context if it was seen, else (and in the first `depth` steps)
    in that of all symbols. The draw is the first 32 bits of the MD5 of `seed:key:step`, so any partitioning, retry or subset of
    keys draws alike.
    """
    table = F.array_sort(F.collect_list(F.struct(F.coalesce("context", F.lit(-1).cast("long")).alias("context"), "counts")))
    rows = tables.groupBy(key).agg(table.alias("_t"))
    drawn = _drawn(F.col(key).cast("string"), F.col("_t.context"), F.col("_t.counts"), steps, bins, depth, seed)
    return rows.select(key, F.posexplode(drawn).alias("step", "symbol"))


def _drawn(key: Column, context: Column, counts: Column, steps: int, bins: int, depth: int, seed: int) -> Column:
    @F.arrow_udf("array<int>")
    def run(keys: pa.Array, known: pa.Array, tables: pa.Array) -> pa.Array:
        out = []
        for k, codes, table in zip(keys.to_pylist(), known.to_pylist(), tables.to_pylist()):
            upto = dict(zip(codes, np.cumsum(np.array(table, np.int64) + 1, axis=1)))
            made, at = [], 0
            for step in range(steps):
                row = upto.get(at, upto[-1]) if step >= depth else upto[-1]
                draw = int(hashlib.md5(f"{seed}:{k}:{step}".encode()).hexdigest()[:8], 16)
                made.append(int(np.searchsorted(row * DRAW, draw * int(row[-1]), "right")))
                at = at // bins + made[-1] * bins ** (depth - 1)
            out.append(made)
        return pa.array(out, pa.list_(pa.int32()))

    return run(key, context, counts)
