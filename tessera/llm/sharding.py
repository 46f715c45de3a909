"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, checksum, size, hash of the text). The permutation sends row r to place
p(r); its shard is p mod n_shards and its slot p div n_shards, so shard sizes differ by at most one row (the `rows` law),
slots are gapless, and both directions can be computed from a row number alone. The permutation acts on the smallest
power of four that holds n; a place of n or more is permuted again until it falls inside, which ends because a
permutation's cycles return.

Row numbers come from a range partitioning of narrow rows (no text), written once; each partition's count is summed into
an offset. Only one count a partition reaches the driver.

Defined cases: a null text has size 16 and checksum 0. Null ids sort first. Rows equal in all of id and text may take
each other's number; the result as a set of rows is the same. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import stored

ROUNDS = 4
U = np.uint64


class Permutation:
    """Feistel permutation of 0..n-1 under a key."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [U(x) for x in np.random.Generator(np.random.PCG64(key)).integers(0, 2**63, ROUNDS)]

    def _f(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * U(0x9E3779B97F4A7C15)
        x ^= x >> U(29)
        x *= U(0xBF58476D1CE4E5B9)
        return (x >> U(32)) & U((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> U(self.half), x & U((1 << self.half) - 1)
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._f(left, key), left
            else:
                left, right = right, left ^ self._f(right, key)
        return left << U(self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), back)
        while (far := np.flatnonzero(out >= U(self.n))).size:
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        """Place of each row number."""
        return self._walk(row, False)

    def row(self, place: np.ndarray) -> np.ndarray:
        """Row number at each place."""
        return self._walk(place, True)


def place_of(row: Column, n: int, key: int) -> Column:
    """Place of a row-number column."""

    @F.arrow_udf("long")
    def placed(column: pa.Array) -> pa.Array:
        return pa.array(Permutation(n, key).place(np.asarray(column)))

    return placed(row)


def number_rows(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """rows with a global `row_number` column (0-based, by `order`), and their count."""
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())  # parts rows that are equal in everything
    parts = salted.repartitionByRange(*order, "_salt").withColumn("_part", F.spark_partition_id()).drop("_salt")
    kept = stored(parts, name)
    counts = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for part, n in counts:
        starts[part] = total
        total += n
    first = rows.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "_part int, _start long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    numbered = kept.withColumn("_n", within).join(F.broadcast(first), "_part").withColumn("row_number", F.col("_start") + F.col("_n") - 1)
    return numbered.drop("_part", "_n", "_start"), total


def assign_shards(docs: DataFrame, *, n_shards: int = 40, key: int = 20_231, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, size, text_crc32, row_number, place, shard, slot."""
    data = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32"), F.xxhash64(data).alias("text_hash"))
    numbered, n = number_rows(narrow, ["doc_id", "text_crc32", "size", "text_hash"], "sharding")
    placed = numbered.withColumn("place", place_of(F.col("row_number"), max(n, 1), key))
    shard, slot = (F.col("place") % n_shards).cast("int"), F.floor(F.col("place") / F.lit(n_shards)).cast("long")
    return placed.select("doc_id", "size", "text_crc32", "text_hash", "row_number", "place", shard.alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, *, n_shards: int = 40, key: int = 20_231, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write docs under path, one folder a shard, rows ordered by slot; returns the assignment.

    Rows of equal id and text are matched to their places in any order. A column `_shard` of docs is replaced by the folder's.
    """
    places = stored(assign_shards(docs, n_shards=n_shards, key=key, text=text, doc_id=doc_id), "shards")
    data = F.coalesce(F.col(text), F.lit(""))
    match = ["_id", "_null", "_hash", "_crc", "_k"]
    parts = lambda i: (F.coalesce(i.cast("long"), F.lit(0).cast("long")).alias("_id"), i.isNull().alias("_null"))
    numbered = lambda df, order: df.withColumn("_k", F.row_number().over(Window.partitionBy(*match[:-1]).orderBy(order)))
    # a row travels as one struct, so no name of its own can clash
    keyed = numbered(docs.drop("_shard").select(F.struct("*").alias("row"), *parts(F.col(doc_id)), F.xxhash64(data).alias("_hash"), F.crc32(data.cast("binary")).alias("_crc")), F.lit(1))
    place = numbered(places.select(*parts(F.col("doc_id")), F.col("text_hash").alias("_hash"), F.col("text_crc32").alias("_crc"), "row_number", "shard", "slot"), F.col("row_number"))
    rows = keyed.join(place, match).select("row", "shard", "slot").repartitionByRange(n_shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)
    return places
