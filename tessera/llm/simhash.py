"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint has 64 bits, one majority vote of the shingle hashes a bit. Fingerprints link at `radius` (3) or fewer
differing bits. Only distinct fingerprints are compared. Each is cut into two halves; of two linked fingerprints, one
half differs by at most one bit. A half is embedded as the bit counts of its sixteen 2-bit segments; the Manhattan
distance of two embeddings is a lower bound of the bits that differ, so such a half has distance 0 or 1. Cells are the
unit grid points of the embedding; a half at distance 1 has one segment count raised by one against the other, so
joining each half's own cell with itself and with the cells one step up finds every candidate. Candidates are then
verified on all 64 bits.

Cells with many fingerprints are cut into blocks and compared block against block, in tasks of bounded size, and each
such comparison returns the edges of a spanning forest instead of all its pairs. Components come from star contraction
over edges, distributed, and the smallest id of each component is attached by joins.

Defined cases: a null or empty text has no words and fingerprint zero, which links like any other; fewer than three
words are one shingle; equal texts share a fingerprint; a null id is never the smallest id unless a component has no
other, then component_id is null. Repeated rows are repeated in the result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored
from tessera.llm._graph import connected_components, forest

SEED = 42
SHINGLE = 3
RADIUS = 3
BLOCK = 512


def text_fingerprint(data: bytes) -> int:
    """Fingerprint of one text given as UTF-8, unsigned."""
    words = data.lower().split()  # bytes: A-Z only, and the six white-space bytes of the word rule
    if not words:
        return 0
    shingles = [b" ".join(x) for x in zip(words, words[1:], words[2:])] if len(words) >= SHINGLE else [b" ".join(words)]
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(digests), 65_536):
        votes += np.unpackbits(digests[at : at + 65_536], axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * votes > len(digests)).tobytes(), "big")


def fingerprint(text: Column | str) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def made(column: pa.Array) -> pa.Array:
        found = np.array([text_fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in column.cast(pa.large_binary())], np.uint64)
        return pa.array(found.view(np.int64))

    return made(text)


def hex_digits(value: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def halves(distinct: DataFrame) -> DataFrame:
    """Rows (side, cell, fp): each half's own cell. A cell packs sixteen segment counts of 0..2, two bits each."""
    half = distinct.select("fp", F.explode(F.expr("array(struct(0 as side, fp & 4294967295L as half), struct(1 as side, shiftrightunsigned(fp, 32) as half))")).alias("h"))
    return half.select("h.side", F.expr("(h.half & 1431655765L) + (shiftright(h.half, 1) & 1431655765L)").alias("cell"), "fp")


def stepped(own: DataFrame) -> DataFrame:
    """Rows (side, cell, up, fp): the own cells and those with one segment count raised by one."""
    steps = "filter(sequence(0, 15), i -> (shiftright(cell, 2 * i) & 3) < 2)"
    to = F.expr(f"concat(array(struct(cell as cell, false as up)), transform({steps}, i -> struct(cell + shiftleft(1L, 2 * i) as cell, true as up)))")
    return own.select("side", "fp", F.explode(to).alias("t")).select("side", "t.cell", "t.up", "fp")


def linked_pairs(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that keep every link within `radius` connected.

    Only own cells are counted; the cells one step up are made inside the join, whose other side is the own cells.
    """
    own = halves(distinct)
    large = stored(own.groupBy("side", "cell").agg(F.count("*").alias("own")).where(F.col("own") > block), "simhash-large")
    a = own.join(large, ["side", "cell"], "left_anti").select("side", "cell", F.col("fp").alias("a"))
    b = stepped(own).select("side", "cell", "up", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = a.join(b, ["side", "cell"]).where((F.col("up") | (F.col("a") < F.col("b"))) & close).select("a", "b")
    return pairs.unionByName(_blocked(stepped(own), large, radius, block))


def _blocked(rows: DataFrame, large: DataFrame, radius: int, block: int) -> DataFrame:
    """Forest edges of the cells with more than `block` own rows: blocks of rows, compared two by two."""
    cut = rows.join(large.select("side", "cell"), ["side", "cell"])
    cut = cut.join(cut.groupBy("side", "cell").agg(F.count("*").alias("n")), ["side", "cell"]).withColumn("k", F.ceil(F.col("n") / block)).withColumn("i", F.pmod(F.xxhash64("fp", "up"), F.col("k")))
    # block i meets every block j: its task (i, j) has i <= j
    dealt = cut.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = dealt.select("side", "cell", F.least("i", "with").alias("i"), F.greatest("i", "with").alias("j"), (F.col("i") <= F.col("with")).alias("first"), "up", "fp")

    def compare(table: pa.Table) -> pa.Table:
        fp, up, first = (np.asarray(table.column(c)) for c in ("fp", "up", "first"))
        one = table.column("i")[0] == table.column("j")[0]
        left, right = (np.arange(len(fp)),) * 2 if one else (np.flatnonzero(first), np.flatnonzero(~first))
        far = np.bitwise_count(fp[left][:, None].view(np.uint64) ^ fp[right][None, :].view(np.uint64))
        x, y = np.nonzero((far <= radius) & ~(up[left][:, None] & up[right][None, :]))
        x, y = forest(fp[left[x]], fp[right[y]])
        return pa.table({"a": pa.array(x), "b": pa.array(y)})

    return dealt.groupBy("side", "cell", "i", "j").applyInArrow(compare, "a long, b long")


def _with_components(made: DataFrame) -> DataFrame:
    """made (doc_id, fp, ...) with component_id (smallest id reachable by links) and root (a fingerprint of the component)."""
    distinct = stored(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(linked_pairs(distinct.select("fp")), "a", "b")
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return made.join(classes.select("fp", "root").join(least, "root"), "fp")


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, fp (signed long), component_id (smallest id reachable by links), root (a fingerprint of the component)."""
    made = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")), "simhash")
    return _with_components(made).select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of docs for each group: the smallest id, of rows with that id the smallest fingerprint, of those any one.

    A row with a null id stays only where its group has no other id. Rows are written once with a number and their
    fingerprint; the numbers that go are a narrow table, whose size decides whether Spark broadcasts it or shuffles the rows.
    """
    # a row travels as one struct, so no name of its own can clash
    rows = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("_row"), fingerprint(F.col(text)).alias("fp")), "simhash-rows")
    found = stored(_with_components(rows.select("_row", F.col("row").getField(doc_id).alias("doc_id"), "fp")), "simhash-found")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("fp", "_row")).alias("m"))
    dropped = stored(found.select("_row").join(first.select("m._row"), "_row", "left_anti"), "simhash-dropped")
    return rows.join(dropped, "_row", "left_anti").select("row.*")
