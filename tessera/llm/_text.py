"""Vectorised views of Arrow string columns: bytes, words, lines and their 64-bit hashes.

Everything works on the UTF-8 bytes of many texts at once. The white-space bytes of the word rule are ASCII, so
splitting bytes splits code points correctly. Hashes are polynomials over random 64-bit byte codes with an odd base
modulo 2**64; prefix sums make the hash of any byte range one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_BYTES = 500_000
U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CODES = [np.random.Generator(np.random.PCG64(s)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for s in (71, 72)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (xor-shift and multiply)."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of base number `which` and of its inverse."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        base = _BASES[which]
        made = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        have = made[0], made[1]
        if n <= 2 * CHUNK_BYTES:  # larger ones are for a single very long text and are not kept
            _powers[which] = have
    return have


class RangeHash:
    """Hash of any byte range of a buffer."""

    def __init__(self, buf: np.ndarray, which: int = 0):
        up, self.down = _power(which, max(len(buf), CHUNK_BYTES))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        codes = _CODES[which][buf]
        codes *= up[: len(buf)]
        np.cumsum(codes, out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end))


@dataclass
class Texts:
    """Bytes of some texts, one after another; text i is buf[offsets[i]:offsets[i + 1]]."""

    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Count of set flags (one a byte) in each text."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def is_space(self) -> np.ndarray:
        return _SPACE[self.buf]

    def words(self) -> "Words":
        word = ~self.is_space()
        first = np.zeros(len(self.buf) + 1, bool)
        first[self.offsets] = True
        before = np.zeros(len(self.buf), bool)
        before[1:] = word[:-1]
        start = np.flatnonzero(word & (~before | first[:-1]))
        after = np.zeros(len(self.buf), bool)
        after[:-1] = word[1:]
        end = np.flatnonzero(word & (~after | first[1:])) + 1
        return Words(start, end, np.searchsorted(self.offsets, start, "right") - 1)


@dataclass
class Words:
    """Byte ranges of words, in order, and the number of the text of each."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def count(self, n_texts: int) -> np.ndarray:
        return np.bincount(self.text, minlength=n_texts).astype(np.int64)


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[Texts]:
    """Chunks of whole texts of about CHUNK_BYTES; a null counts as empty, a longer text is a chunk of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        stop = min(stop, len(column), at + 100_000)
        own = offsets[at : stop + 1]
        yield Texts(data[own[0] : own[-1]], own - own[0])
        at = stop


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    flag = np.zeros(len(keys), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def packed(column: pa.Array) -> pa.Array:
    """Each value compressed, with its size in front."""
    codec = pa.Codec("zstd", 1)
    out = []
    for x in column.cast(pa.large_binary()).fill_null(b""):
        data = x.as_buffer()
        out.append(data.size.to_bytes(8, "little") + codec.compress(data, asbytes=True))
    return pa.array(out, pa.binary())


def unpacked(z: bytes) -> bytes:
    size = int.from_bytes(z[:8], "little")
    return pa.Codec("zstd").decompress(z[8:], size, asbytes=True) if size else b""


def zipped(text: Column) -> Column:
    """Compressed bytes of a text column, for shuffles of whole texts."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return packed(column)

    return run(text)


def unzipped(z: Column) -> Column:
    """Texts of a column that zipped() made."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([unpacked(x.as_py()).decode() if x.is_valid else None for x in column], pa.string())

    return run(z)
