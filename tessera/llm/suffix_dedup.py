"""Removal of long repeated byte strings with a run-length (r-) index.

A byte goes if a string of `length` (400) bytes that covers it starts at another place too, in any document.

Every window of 400 bytes belongs to the smallest hash of its 32-byte grams, its anchor; consecutive windows with the same
anchor place form a run, and a run's text holds just its own windows. Equal windows have equal anchors, so only runs
with an anchor that occurs twice can hold a match, and windows are only compared under one anchor. Runs with equal text
form a class: a class of two or more runs matches whole. A scan joins the equal runs of a chunk of texts in one row, so
that a group of copies travels as a few rows, not one a copy, and a periodic text as one row a class, not one a period.

Anchors with several classes are settled on one text of each class by a run-length index. The classes of an anchor are cut
into parts of about `most_classes`, whole parts are put together until a batch is full, and the index of the batch is
built: suffix order by prefix doubling, the Burrows-Wheeler transform, its runs, and suffix samples at run ends. Only at
run ends are match lengths computed; matching statistics are then streamed in text order, each one less than the last
until the next sample. A window start whose longest match with either neighbour in suffix order reaches 400 is marked.

An anchor with several parts (a passage that very many texts share) may hold windows that match between parts only. Each
part sends the hashes of its distinct windows, a repeated one once, to buckets of hashes, where windows of two parts meet.
Run and window equality rest on two 64-bit hashes of different families (a polynomial and XXH3).

Defined cases: a null or empty text, or one under 400 bytes, loses nothing. Matches never cross documents. Rows that
repeat (same id and text) are places of their own, so their whole text goes if it has 400 bytes; a null id is an id like
any other, and ids may be of any type. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored
from tessera.llm._text import RangeHash, Texts, U, texts, unpacked, zipped

LENGTH = 400
GRAM = 32
BATCH_BYTES = 400_000
MOST_CLASSES = 400
BUCKET_WINDOWS = 400_000
WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc_id", "<i8"), ("th", "<i8"), ("start", "<i4"), ("k", "<i4"), ("open", "?")])
SEPARATOR, START = 0xFF, 0x100
CLASS = ["anchor", "c1", "c2"]


def run_table(t: Texts, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Runs of the texts of a chunk: text number, start, n (windows), anchor, c1, c2."""
    n, width = len(t.buf), length - GRAM + 1
    empty = {k: np.empty(0, np.int64) for k in ("text", "start", "n", "anchor", "c1", "c2")}
    if n < length:
        return empty
    h = RangeHash(t.buf)
    at = np.arange(n - GRAM + 1)
    grams = h.of(at, at + GRAM)
    # smallest gram of each window, the leftmost of equals: order by the upper 30 bits, then by place
    mask = U((1 << 34) - 1)
    order = (grams & ~mask) | at.astype(np.uint64)
    pad = -len(order) % width
    blocks = np.concatenate([order, np.full(pad, ~U(0))]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = (np.minimum(right[:starts], left[width - 1 : width - 1 + starts]) & mask).astype(np.int64)
    # windows that lie in one text
    inside = np.zeros(starts, bool)
    for a, b in zip(t.offsets[:-1][t.sizes >= length], t.offsets[1:][t.sizes >= length]):
        inside[a : b - length + 1] = True
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new)
    stop = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False)) + 1
    end = stop - 1 + length
    text = np.searchsorted(t.offsets, start, "right") - 1
    return {"text": text, "start": start - t.offsets[text], "n": stop - start, "anchor": grams[least[start]].view(np.int64), "c1": h.of(start, end).view(np.int64), "c2": second_hash(t.buf, start, end).view(np.int64)}


def second_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of byte ranges: of another family than the polynomial hash."""
    view, of = memoryview(buf), xxhash.xxh3_64_intdigest
    return np.fromiter((of(view[a:b], 7) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))


def collapsed(runs: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal runs of a chunk: order (runs by class, first places first), first (where classes begin in it), copies."""
    order = np.lexsort((runs["start"], runs["text"], runs["c2"], runs["c1"], runs["anchor"]))
    new = np.ones(len(order), bool)
    new[1:] = np.any([runs[c][order][1:] != runs[c][order][:-1] for c in CLASS], axis=0)
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def window_runs(keyed: DataFrame, length: int) -> DataFrame:
    """Runs of all documents of keyed (doc_id, th, text), the equal ones of a chunk in one row.

    A row has the first place (doc_id, th, start, n), the class, the number of copies and the places of the others as four
    lists, null where there are none.
    """
    kind = "doc_id long, th long, start int, n int, anchor long, c1 long, c2 long, copies long, docs array<long>, ths array<long>, starts array<int>, ns array<int>"
    names = [x.split()[0] for x in kind.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            ids = [np.asarray(batch.column(c)) for c in (0, 1)]
            for t in texts(batch.column(2)):
                runs = run_table(t, length)
                order, first, copies = collapsed(runs)
                row = runs["text"][order] + at
                place = [ids[0][row], ids[1][row], *(runs[k][order].astype(np.int32) for k in ("start", "n"))]
                more = np.ones(len(order), bool)
                more[first] = False
                ends = np.concatenate([[0], np.cumsum(copies - 1)]).astype(np.int32)
                offsets = pa.array(ends, mask=np.append(copies == 1, False))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[more])) for x in place]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[first]) for x in place), *(pa.array(runs[k][order][first]) for k in CLASS), pa.array(copies), *lists], names)
                at += len(t)

    return keyed.select("doc_id", "th", "text").mapInArrow(scan, kind)


def suffix_order(buf: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first `depth` bytes at least (prefix doubling over groups that are still tied)."""
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = word << U(8) | padded[k : k + n]
    order = np.argsort(word, kind="stable")
    w = word[order]
    head = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    rank[n] = -1
    h = 8
    while h < depth:
        r = rank[order]
        tied = np.concatenate([r[1:] == r[:-1], [False]])
        tied[1:] |= tied[:-1]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        own = order[slots]
        key = (rank[own] << 32) | (rank[np.minimum(own + h, n)] + 1)
        inner = np.argsort(key, kind="stable")
        order[slots] = own[inner]
        k = key[inner]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        h *= 2
    return order


class RunIndex:
    """Run-length index of a text: runs of its Burrows-Wheeler transform and suffix samples at their ends."""

    def __init__(self, buf: np.ndarray, depth: int):
        self.buf, self.depth = buf, depth
        order = suffix_order(buf, depth)
        bwt = buf[order - 1].astype(np.int16)
        bwt[order == 0] = START  # a run of its own: no place before it to stream from
        cut = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.heads = np.concatenate([[0], cut])  # places in suffix order where runs begin
        self.letters = bwt[self.heads]
        tails = np.append(cut, len(buf)) - 1
        self.first, self.last = order[self.heads], order[tails]  # suffix samples
        self.before, self.after = order[self.heads[1:] - 1], order[tails[:-1] + 1]  # their neighbours over the run's edge

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix length of suffix pairs, up to the depth, by bisection on range hashes."""
        h, n = RangeHash(self.buf), len(self.buf)
        low, high = np.zeros(len(a), np.int64), np.minimum(self.depth, n - np.maximum(a, b))
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = h.raw(a, a + mid) == h.raw(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def matching_statistics(self) -> np.ndarray:
        """Longest match of every suffix with another one, as far as it is within the depth."""
        n = len(self.buf)
        best = np.zeros(n, np.int64)
        for sample, other in ((self.first[1:], self.before), (self.last[:-1], self.after)):
            length, known = np.zeros(n, np.int64), np.zeros(n, bool)
            length[sample], known[sample] = self._common(sample, other), True
            known[0] = True
            edge = self.first[0] if other is self.before else self.last[-1]
            known[edge] = True  # the first (last) suffix has no neighbour on that side
            near = np.maximum.accumulate(np.where(known, np.arange(n), 0))
            best = np.maximum(best, length[near] - (np.arange(n) - near))
        return best


def marked_windows(slices: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each slice, which of its first counts[i] window starts occur elsewhere among the slices."""
    sizes = np.array([len(s) + 1 for s in slices])
    at = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(s + bytes([SEPARATOR]) for s in slices), np.uint8)
    hit = RunIndex(buf, 4 * length + 8).matching_statistics() >= length
    return [hit[a : a + c] for a, c in zip(at, counts)]


def ranges(flags: np.ndarray) -> list[int]:
    """Set flags as a flat list of begin, end, begin, end, ..."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.tolist()


def _slices(keyed: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """Text of one run of each class: classes has anchor, copies, parts, part and rep (doc_id, th, start, n)."""
    about = ["anchor", "copies", "parts", "part"]
    wanted = classes.select(*about, "rep.*").groupBy("doc_id", "th").agg(F.collect_list(F.struct(*about, "start", "n")).alias("runs"))
    # a row that repeats is cut twice; that only repeats texts of classes with copies, which match whole anyway
    joined = keyed.join(wanted, ["doc_id", "th"]).select("doc_id", "th", "z", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), *((c, pa.int64()) for c in about), ("start", pa.int32()), ("n", pa.int32()), ("slice", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for doc, th, z, runs in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    data = unpacked(z)
                    rows += [r | {"doc_id": doc, "th": th, "slice": data[r["start"] : r["start"] + r["n"] - 1 + length]} for r in runs]
                yield from pa.Table.from_pylist(rows, kind).to_batches(max_chunksize=4096)

    return joined.mapInArrow(cut, "doc_id long, th long, anchor long, copies long, parts long, part long, start int, n int, slice binary")


def _indexed(slices: DataFrame, length: int) -> DataFrame:
    """Marked ranges of the single classes (doc_id, th, start, marked), whole parts of anchors a batch.

    For parts of an anchor that has several, `hashes` holds the windows that may match in another part, packed.
    """

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        found = marked_windows([r[6] for r in rows], np.array([r[5] for r in rows]), length)
        out = [(r[0], r[1], r[4], ranges(f), None) for r, f in zip(rows, found) if r[3] == 1 and f.any()]
        split: dict[tuple, list[int]] = {}
        for i, r in enumerate(rows):
            if r[7] > 1:
                split.setdefault((r[2], r[8]), []).append(i)
        out += [(0, 0, 0, None, distinct_windows([rows[i] for i in own], [found[i] for i in own], length)) for own in split.values()]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["doc_id", "th", "start", "marked", "hashes"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "anchor", "copies", "start", "n", "slice", "parts", "part"))):
                if size >= BATCH_BYTES and (row[2], row[8]) != (rows[-1][2], rows[-1][8]):
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
        if rows:
            yield settle(rows)

    dealt = slices.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(mark, "doc_id long, th long, start int, marked array<int>, hashes binary")


def distinct_windows(rows: list[tuple], found: list[np.ndarray], length: int) -> bytes:
    """The distinct windows of one part as packed WINDOW records.

    A window is open if it belongs to a single class and occurs once in the part: it alone still waits for a match.
    """
    sizes = np.array([len(r[6]) for r in rows])
    buf = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    n = np.array([r[5] for r in rows])
    row = np.repeat(np.arange(len(rows)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = (np.cumsum(sizes) - sizes)[row] + k
    w = np.zeros(len(row), WINDOW)
    w["h1"], w["h2"] = RangeHash(buf).of(place, place + length), second_hash(buf, place, place + length)
    for i, c in ((0, "doc_id"), (1, "th"), (4, "start")):
        w[c] = np.array([r[i] for r in rows])[row]
    w["k"], w["open"] = k, np.array([r[3] == 1 for r in rows])[row] & ~np.concatenate(found)
    w = w[np.lexsort((w["h2"], w["h1"]))]
    return w[np.insert((w["h1"][1:] != w["h1"][:-1]) | (w["h2"][1:] != w["h2"][:-1]), 0, True)].tobytes()


def _met(parts: DataFrame, n_buckets: int) -> DataFrame:
    """Marked ranges of open windows that occur in another part too."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                w = np.frombuffer(x.as_py(), WINDOW)
                bucket = (w["h1"] >> U(20)) % U(n_buckets)
                order = np.argsort(bucket, kind="stable")
                w, bucket = w[order], bucket[order]
                cut = np.flatnonzero(np.insert(bucket[1:] != bucket[:-1], 0, True))
                lists = [w[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(w)))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int64)), pa.array(lists, pa.binary())], ["bucket", "windows"])

    def meet(table: pa.Table) -> pa.Table:
        w = np.frombuffer(b"".join(table.column("windows").to_pylist()), WINDOW)
        w = w[np.lexsort((w["h2"], w["h1"]))]
        same = (w["h1"][1:] == w["h1"][:-1]) & (w["h2"][1:] == w["h2"][:-1])
        w = w[(np.append(same, False) | np.insert(same, 0, False)) & w["open"]]
        w = w[np.lexsort((w["k"], w["start"], w["th"], w["doc_id"]))]
        own = ["doc_id", "th", "start"]
        cut = np.flatnonzero(np.insert(w[own][1:] != w[own][:-1], 0, True)) if len(w) else np.empty(0, np.int64)
        edges = np.stack([w["k"], w["k"] + 1], 1).ravel()
        marked = pa.ListArray.from_arrays(pa.array(np.append(2 * cut, 2 * len(w)).astype(np.int32)), pa.array(edges.astype(np.int32)))
        return pa.table({c: pa.array(w[c][cut]) for c in own} | {"marked": marked})

    windows = parts.select("hashes").mapInArrow(deal, "bucket long, windows binary")
    return windows.groupBy("bucket").applyInArrow(meet, "doc_id long, th long, start int, marked array<int>")


def span_id(doc_id: Column) -> Column:
    """Number under which spans are kept, for ids of any type. Spans follow from the text alone, so ids may share a number."""
    return F.coalesce(doc_id.try_cast("long"), F.xxhash64(doc_id))


def find_spans(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, most_classes: int = MOST_CLASSES) -> DataFrame:
    """(doc_id, th, spans): byte ranges to remove, as an array of begin and end in any order, overlapping or not.

    th is xxhash64 of the text; documents without a span have no row.
    """
    keyed = docs.select(span_id(F.col(doc_id)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    long_enough = keyed.where(F.octet_length("text") >= length)
    runs = stored(window_runs(long_enough, length), "suffix-runs")
    # written first: both sides of the join are then plain exchanges, whose large partitions Spark can split
    repeated = stored(runs.groupBy("anchor").agg(F.sum("copies").alias("places")).where("places > 1").select("anchor"), "suffix-repeated")
    hits = stored(runs.join(repeated, "anchor"), "suffix-hits")
    classes = stored(hits.groupBy(*CLASS).agg(F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "th", "start", "n")).alias("rep")), "suffix-classes")
    contested = stored(classes.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), "suffix-contested")
    parts = F.ceil(F.col("k") / most_classes)
    dealt = classes.join(contested, "anchor").withColumn("parts", parts).withColumn("part", F.pmod(F.col("c2"), F.col("parts")))
    texts_of = keyed.where(F.octet_length("text") >= length).select("doc_id", "th", zipped(F.col("text")).alias("z"))
    found = stored(_indexed(_slices(texts_of, dealt, length), length), "suffix-marked")
    hashed = found.where("hashes is not null")
    total = hashed.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    met = _met(hashed, max(64, -(-total // (BUCKET_WINDOWS * WINDOW.itemsize))))
    single = found.where("marked is not null").drop("hashes").unionByName(met)
    edges = F.transform(F.sequence(F.lit(0), (F.size("marked") / 2 - 1).cast("int")), lambda i: F.struct((F.col("start") + F.get("marked", 2 * i)).alias("b"), (F.col("start") + F.get("marked", 2 * i + 1) - 1 + length).alias("e")))
    some = single.select("doc_id", "th", edges.alias("s"))
    copied = hits.join(classes.where("copies > 1").select(*CLASS), CLASS)
    others = F.transform(F.arrays_zip("docs", "ths", "starts", "ns"), lambda p: F.struct(p["docs"].alias("doc_id"), p["ths"].alias("th"), p["starts"].alias("start"), p["ns"].alias("n")))
    place = F.array(F.struct("doc_id", "th", "start", "n"))
    copied = copied.select(F.explode(F.when(F.col("docs").isNull(), place).otherwise(F.concat(place, others))).alias("p")).select("p.*")
    whole = copied.select("doc_id", "th", F.array(F.struct(F.col("start").alias("b"), (F.col("start") + F.col("n") - 1 + length).alias("e"))).alias("s"))
    return some.unionByName(whole).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("s")).alias("spans"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint, not touching ranges of the same bytes, in order."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > end[:-1]])
    return np.stack([spans[new, 0], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], 1)


def kept_bytes(data: bytes, spans: np.ndarray) -> bytes:
    """data without the merged spans."""
    edges = [0, *spans.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _span_lists(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield merged(np.array([(s["b"], s["e"]) for s in x.as_py()], np.int64)) if x.is_valid else np.empty((0, 2), np.int64)


def removal_digest(docs: DataFrame, *, kept_text: bool = False, **options) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with kept_text the text that stays.

    A character that a cut leaves in part is not in that text; the digest is of the bytes.
    """
    spans = find_spans(docs, **options)
    text, doc_id = F.coalesce(F.col(options.get("text", "text")), F.lit("")), F.col(options.get("doc_id", "doc_id"))
    keyed = docs.select(doc_id.alias("doc_id"), span_id(doc_id).alias("_id"), F.xxhash64(text).alias("_th"), zipped(text).alias("z"))
    joined = keyed.join(spans.withColumnsRenamed({"doc_id": "_id", "th": "_th", "spans": "_spans"}), ["_id", "_th"], "left")
    kind = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("text", pa.string())] * kept_text

    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string" + ", text: string" * kept_text + ">")
    def digest(z: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for x, s in zip(z, _span_lists(spans)):
            data = unpacked(x.as_py())
            kept = kept_bytes(data, s)
            rows.append({"n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(s), "kept_sha256": hashlib.sha256(kept).hexdigest()})
            if kept_text:
                rows[-1]["text"] = kept.decode("utf-8", "ignore")
        return pa.array(rows, pa.struct(kind))

    return joined.select("doc_id", digest("z", "_spans").alias("d")).select("doc_id", "d.*")


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_words: int = 0, **options) -> DataFrame:
    """docs with the repeated bytes cut out of the text; a character that a cut leaves in part goes as a whole.

    min_words: a maximal repeated run of fewer words (or parts of words) than that stays.
    """
    spans = find_spans(docs, text=text, doc_id=doc_id, **options)

    def without(value: str, spans: np.ndarray) -> str:
        data = value.encode()
        wide = [len(data[a:b].split()) >= min_words for a, b in spans.tolist()]
        return kept_bytes(data, spans[np.array(wide, bool)]).decode("utf-8", "ignore")

    @F.arrow_udf("string")
    def cut(column: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([without(x.as_py(), s) if x.is_valid else None for x, s in zip(column, _span_lists(spans))], pa.string())

    # a row travels as one struct, so no name of its own can clash
    keyed = docs.select(F.struct("*").alias("row"), span_id(F.col(doc_id)).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"))
    joined = keyed.join(spans.withColumnsRenamed({"doc_id": "_id", "th": "_th", "spans": "_spans"}), ["_id", "_th"], "left")
    return joined.select(F.col("row").withField(f"`{text}`", cut(F.col("row").getField(text), F.col("_spans"))).alias("row")).select("row.*")
