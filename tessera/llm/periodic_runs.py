"""Periodic runs of words: an online dynamic program over sparse diagonals.

A run is a maximal stretch of consecutive words whose smallest period q it holds at least `power` times, and which has at
least `min_words` words. On the diagonal of lag q, on which a word meets the word q before it, such a run is a row of at least
max(min_words - q, (power - 1) * q) matches, so of at least 16 by default. The symbols of the program are therefore windows of
so many words: a text is read once, each window's earlier occurrences extend the active diagonals of their lags or open new
ones, and a diagonal that is not extended is closed and, if long enough, emitted at once. Windows that occur once in their
text open nothing; they are sorted out first by hashes, and in texts without a repeated window (most) nothing else is done.
Windows themselves are compared by exact numbers, not by hashes.

Inside an open stretch of a period q no longer than a window, occurrences lie q apart, and all but the nearest belong to
diagonals of multiples of q, whose stretches repeat with q as well: they are passed over, so that a text of one repeated word is
linear. A stretch found by several lags is kept with the smallest.

One Arrow UDF over the whole text; no shuffle. Memory: the numbers of a text's words and one number a lag.

Defined cases: a null or empty text has no runs, and its collapsed text is empty. Words are `[^\\x20\\x09-\\x0D]+`, compared by
their UTF-8 bytes. Rows are independent, so ties and repeated rows come out alike; other columns pass through.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, POWER = 24, 3
RESULT = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def shortest_match(min_words: int, power: int) -> int:
    """Fewest matches in a row on the diagonal of a run, over all periods."""
    return min(max(min_words - q, (power - 1) * q) for q in range(1, min_words + 1))


def _windows(symbols: np.ndarray, k: int, join) -> np.ndarray:
    """A symbol for each window of k symbols, by doubling: join(a, b) is the symbol of two neighbours."""
    size, out = 1, symbols
    while size < k:
        step = min(size, k - size)
        out = join(out[:-step], out[step:])
        size += step
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = int(b.max()) + 1
    return np.unique(a * top + b, return_inverse=True)[1]


def find_runs(words: list[bytes], min_words: int = MIN_WORDS, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    k = shortest_match(min_words, power)
    if len(words) < max(min_words, k + 1):
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.sort(_windows(hashes, k, _mixed))
    if not (windows[1:] == windows[:-1]).any():
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    windows = _windows(ids, k, _numbered)
    places = np.argsort(windows, kind="stable")  # occurrences of a window side by side, in text order
    group = windows[places]
    first = np.searchsorted(group, windows)
    rank = np.empty(len(windows), np.int64)
    rank[places] = np.arange(len(windows)) - np.searchsorted(group, group)

    begun, last = np.zeros(len(words), np.int64), np.full(len(words), -2)  # first and last window of a lag's diagonal
    found: dict[tuple[int, int], int] = {}

    def close(lags: np.ndarray) -> None:
        size = last[lags] + k - begun[lags] + lags
        for q, n in zip(*(x[size >= np.maximum(min_words, power * lags)].tolist() for x in (lags, size))):
            at = int(begun[q]) - q, n
            found[at] = min(q, found.get(at, q))

    active, before = np.empty(0, np.int64), -2
    for i in np.flatnonzero(rank).tolist():
        if i != before + 1:
            close(active)
            active = active[:0]
        earlier = places[first[i] : first[i] + rank[i]]
        q = i - int(earlier[-1])
        if q <= k and last[q] == i - 1 and len(earlier) > 1:
            outside = np.searchsorted(earlier, begun[q] - q)
            earlier = np.append(earlier[:outside], earlier[-1])
        lags = i - earlier
        new = lags[last[lags] != i - 1]
        last[lags] = i
        ended = active[last[active] != i]
        if len(ended):
            close(ended)
        begun[new] = i
        active, before = lags, i
    close(active)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        words = list(compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))
    return b" ".join(words)


def periodic_runs(text: Column, min_words: int = MIN_WORDS, power: int = POWER) -> Column:
    """Struct of the runs of a text column and its collapsed text."""

    @F.arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        runs, kept = [], []
        for x in column.cast(pa.large_binary()):
            words = (x.as_py() or b"").split()
            own = find_runs(words, min_words, power)
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            kept.append(collapse(words, own).decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(runs, kind), pa.array(kept, pa.string())], ["runs", "collapsed"])

    return run(text)


def repeated_tail(text: Column, seed: Column) -> Column:
    """Text whose words from word a on repeat with period p, for tests of run detection; unchanged where seed is null.

    a = seed % n and p = 1 + (n - a) // (3 + seed % 8) for n words; the result's words are joined by one space.
    """

    @F.arrow_udf("string")
    def run(column: pa.Array, seeds: pa.Array) -> pa.Array:
        out = []
        for x, g in zip(column.cast(pa.large_binary()), seeds.to_pylist()):
            words = (x.as_py() or b"").split() if g is not None else []
            if words:
                a = g % len(words)
                p = 1 + (len(words) - a) // (3 + g % 8)
                rest = len(words) - a
                words = words[:a] + (words[a : a + p] * -(-rest // p))[:rest]
            out.append(b" ".join(words).decode() if words else None)
        return pa.array(out, pa.string())

    return F.coalesce(run(F.when(seed.isNotNull(), text), seed), text)


def run_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for doc_id and text, a tenth of the texts with a repeated tail."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    seed = F.when(h % 10 == 0, F.floor(h / 10).cast("long"))
    made = docs.select("doc_id", periodic_runs(repeated_tail(F.col("text"), seed)).alias("made")).select("doc_id", "made.*")
    denser = lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = made.withColumn("best", F.aggregate("runs", none, denser))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
