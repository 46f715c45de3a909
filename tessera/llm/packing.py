"""Variable-capacity best-fit packing of texts into training sequences.

Texts longer than the largest permitted length are cut into pieces of that length and a rest. Pieces are dealt by a hash
into groups of bounded expected size, and each group is packed by best fit in decreasing length: a piece goes into the
open bin with the least room that still holds it. Where none does, all permitted lengths that hold the piece are weighed
against each other: each one's bin is filled on trial with the largest pieces still to come that fit, and the length is
opened whose filled bin costs least, in padding for each unit packed (of equal ones the larger, as fewer sequences are
fewer separators and steps). So a longer bin is opened where the pieces to come fill it better, a shorter one where they do
not. Pieces of the trial may later find tighter bins; so at the end every bin is downsized to the smallest permitted length
that holds its contents.

The number of groups grows with the input, so no task holds more than a group, and every piece of every text is packed.

Defined cases: a null or empty text is one piece of length 0 (it needs no room but its separator, if any). Pieces of
equal length are taken in the order of (doc_id, piece); repeated rows are packed as pieces of their own. Ids may be of any type
that sorts. Bins follow from the rows alone, not from the files they lie in. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored

LENGTHS = (2_048, 4_096, 8_192, 16_384)
GROUP_PIECES = 8_000


class _Rooms:
    """Open bins by the room they have left; finds the least room of at least some size.

    Rooms with bins are marked in a tree of 64-bit words, so a search looks at three words.
    """

    def __init__(self, largest: int):
        self.bins: list[list[int]] = [[] for _ in range(largest + 1)]
        self.levels: list[list[int]] = []
        n = largest + 1
        while n > 1:
            n = (n + 63) // 64
            self.levels.append([0] * n)

    def add(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        at = room
        for level in self.levels:
            level[at >> 6] |= 1 << (at & 63)
            at >>= 6

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove a bin with the least room >= size; the oldest of those that came to it last is as good as any."""
        at = size
        for depth, level in enumerate(self.levels):
            if at >> 6 >= len(level):
                return None
            word = level[at >> 6] >> (at & 63)
            if word:
                at += (word & -word).bit_length() - 1
                for lower in reversed(self.levels[:depth]):
                    word = lower[at]
                    at = at << 6 | (word & -word).bit_length() - 1
                return self._pop(at)
            at = (at >> 6) + 1
        return None

    def _pop(self, room: int) -> tuple[int, int]:
        b = self.bins[room].pop()
        if not self.bins[room]:
            at = room
            for level in self.levels:
                level[at >> 6] &= ~(1 << (at & 63))
                if level[at >> 6]:
                    break
                at >>= 6
        return room, b


def trial_fill(upto: Sequence[int], falling: Sequence[int], at: int, room: int) -> int:
    """Units of the largest pieces from place `at` on that fit into a room, one after another.

    falling holds the negated sizes, so that it rises, and upto the sums of the sizes before each place: pieces that follow one
    another are taken at once, and then those that are too large are passed over at once.
    """
    filled = 0
    while True:
        at = bisect_left(falling, -room, at)
        if at == len(falling) or not falling[at]:
            return filled
        stop = bisect_right(upto, upto[at] + room, at) - 1
        filled, room, at = filled + upto[stop] - upto[at], room - upto[stop] + upto[at], stop


def opened_length(upto: Sequence[int], falling: Sequence[int], at: int, lengths: Sequence[int]) -> int:
    """Permitted length (sorted) to open for the piece at a place: the one whose bin, filled on trial, pads least."""
    size = -falling[at]
    best = None
    for c in lengths[bisect_left(lengths, size) :]:
        used = size + trial_fill(upto, falling, at + 1, c - size)
        if used <= lengths[-1] and lengths[bisect_left(lengths, used)] != c:
            continue  # the pieces to come do not fill it; it would be downsized
        cost = (c - used) / max(used, 1), -c
        if best is None or cost < best[0]:
            best = cost, c
    return best[1] if best else lengths[bisect_left(lengths, size)]


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and start of each piece, and the length of each bin. sizes must be in decreasing order, none over the largest length."""
    lengths, sizes = sorted(lengths), [int(x) for x in sizes]
    falling, upto = [-x for x in sizes], [0, *accumulate(sizes)]
    rooms, bins, starts = _Rooms(lengths[-1]), [], []
    used: list[int] = []
    for at, size in enumerate(sizes):
        found = rooms.take(size)
        if found is None:
            room, b = opened_length(upto, falling, at, lengths), len(used)
            used.append(0)
        else:
            room, b = found
        bins.append(b)
        starts.append(used[b])
        used[b] += size
        rooms.add(room - size, b)
    final = [lengths[bisect_left(lengths, u)] for u in used]
    return np.array(bins, np.int64), np.array(starts, np.int64), np.array(final, np.int64)


def pieces(docs: DataFrame, largest: int, *, size: Column, doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, piece, piece_start, piece_size): each document cut at multiples of the largest length."""
    cut = docs.select(F.col(doc_id).alias("doc_id"), size.cast("long").alias("_size"))
    last = F.greatest(F.ceil(F.col("_size") / largest) - 1, F.lit(0))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece") * largest
    return cut.select("doc_id", "piece", start.alias("piece_start"), F.least(F.lit(largest), F.col("_size") - start).alias("piece_size"))


def best_fit(docs: DataFrame, *, size: Column | None = None, lengths: Sequence[int] = LENGTHS, group_pieces: int = GROUP_PIECES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents; returns per piece: doc_id, piece, piece_start, piece_size, bin_id, bin_offset, bin_length.

    size: units a document takes (default: UTF-8 bytes of the text, the tokens of a byte-level model).
    """
    largest = max(lengths)
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))) if size is None else size
    # pieces that are equal in everything are counted, so that each has a number: groups do not depend on the files' splits
    same = ["doc_id", "piece", "piece_start", "piece_size"]
    cut = stored(pieces(docs, largest, size=size, doc_id=doc_id).groupBy(*same).agg(F.count("*").alias("copies")), "packing")
    n_groups = max(1, -(-(cut.agg(F.sum("copies")).first()[0] or 0) // group_pieces))
    each = cut.select(*same, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    grouped = each.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "piece_size", "copy"), F.lit(n_groups))).drop("copy")
    kind = dict(cut.dtypes)["doc_id"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("piece_size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, starts, final = pack(table.column("piece_size").to_pylist(), lengths)
        group = np.asarray(table.column("group"))
        out = {"bin_id": pa.array(group << 32 | bins), "bin_offset": pa.array(starts), "bin_length": pa.array(final[bins])}
        return pa.table({c: table.column(c) for c in ("doc_id", "piece", "piece_start", "piece_size")} | out)

    return grouped.groupBy("group").applyInArrow(run, f"doc_id {kind}, piece long, piece_start long, piece_size long, bin_id long, bin_offset long, bin_length long")
