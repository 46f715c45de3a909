"""WARC archives with a two-level capture index.

`write_archive` writes each page as one gzip member of a WARC file, one file a task; of pages with equal payloads the one
with the largest page_id is the response and the others revisit it. `build_index` sorts the capture keys (reversed host,
path, page_id) by range; every range is one index file of compressed blocks of `BLOCK_ROWS` sorted entries followed by its
sparse block directory (first key, offset and length of each block). `read_captures` sorts the wanted keys, finds the
range by its first key, the block by binary search in the directory, the entry by binary search in the block, and then
reads just the record's bytes from the archive.

Only one row an index file reaches the driver, and their number is the number of ranges, a parameter. Files are written
under names of their own and listed in a table when their task has succeeded, so a repeated task leaves at most an
unlisted file.

Defined cases: a null html is an empty payload; a null url has the empty key; a null page_id sorts first, is never a
response while its payload has a page with an id, and is returned as null. Rows with the same page_id and payload are
captures of their own with the same record type. A line break in a url is written as %0D or %0A and is returned so. An empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import scratch, stored

BLOCK_ROWS = 256
FILE_BYTES = 1 << 30
READ_BYTES = 8 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CAPTURE = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_CAPTURE_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given by URI or local path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def surt(url: Column) -> Column:
    """Sort-friendly key: host labels reversed and joined by commas, then the path and query."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)$"
    host = F.regexp_replace(F.lower(F.regexp_extract(whole, pattern, 1)), r":\d*$", "")
    return F.when(host == "", whole).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(whole, pattern, 2)))


def digest_text(sha1_hex: str) -> str:
    """Base32 of a SHA-1 given in hex."""
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; refers_to makes it a revisit, which holds no payload."""
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = HTTP if refers_to is not None else HTTP + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Capture row of one record; the digest and size of a response are those of the payload read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    out = {"page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": None, "payload": payload}
    if out["record_type"] == "revisit":
        return out | {"payload": None, "refers_to": int(fields["WARC-Refers-To"][len("<urn:page:") : -1]), "payload_digest": fields["WARC-Payload-Digest"][5:], "payload_bytes": int(fields["WARC-Payload-Length"])}
    return out | {"payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload_bytes": len(payload)}


def _member(data: bytes) -> bytes:
    packed = io.BytesIO()
    with gzip.GzipFile(fileobj=packed, mode="wb", compresslevel=1, mtime=0) as z:
        z.write(data)
    return packed.getvalue()


def write_archive(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write WARC files under path; returns their captures: key, page_id, file, offset, length."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("key", surt(F.col("url"))).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    largest = rows.groupBy("sha1").agg(F.max("page_id").alias("response"))
    joined = rows.join(largest, "sha1").select("page_id", "url", "html", "key", "sha1", F.when((F.col("page_id") == F.col("response")) | F.col("response").isNull(), None).otherwise(F.col("response")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(path)
        out = name = None
        at = 0
        try:
            for batch in batches:
                cols, found = batch.to_pydict(), ([], [], [], [], [])
                for i in range(batch.num_rows):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        else:
                            store.create_dir(folder, recursive=True)
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    data = _member(record(cols["page_id"][i], cols["url"][i], digest_text(cols["sha1"][i]), cols["html"][i].encode(), cols["refers_to"][i]))
                    out.write(data)
                    for column, value in zip(found, (cols["key"][i], cols["page_id"][i], name, at, len(data))):
                        column.append(value)
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return stored(joined.mapInArrow(write, "key string, page_id long, file string, offset long, length long"), "warc-captures")


Key = tuple[bytes, bool, int]


def _key(key: str | None, page_id: int | None) -> Key:
    return (key or "").encode(), page_id is not None, page_id or 0


@dataclass
class CaptureIndex:
    """Top of the index: first key and place of each index file, in key order."""

    path: str
    archive: str
    first: list[Key]
    files: list[tuple[str, int, int]]


def build_index(captures: DataFrame, path: str, archive: str, *, n_ranges: int | None = None) -> CaptureIndex:
    """Write the index files of the captures under path."""
    order = ["key", "page_id"]
    salted = captures.withColumn("_salt", F.xxhash64("file", "offset"))
    ranged = salted.repartitionByRange(n_ranges, *order, "_salt") if n_ranges else salted.repartitionByRange(*order, "_salt")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, pending, at, out, name = [], [], 0, None, ""

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in pending).encode(), 6)
            directory.append([*pending[0][:2], at, len(data)])
            out.write(data)
            at += len(data)
            pending.clear()

        for batch in batches:
            cols = batch.to_pydict()
            for entry in zip(cols["key"], cols["page_id"], cols["file"], cols["offset"], cols["length"]):
                if out is None:
                    store, folder = store_of(path)
                    store.create_dir(folder, recursive=True)
                    name = f"captures-{uuid.uuid4().hex}.idx"
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                pending.append(entry)
                if len(pending) == BLOCK_ROWS:
                    flush()
        if out is None:
            return
        if pending:
            flush()
        tail = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(tail)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(tail)], pa.int64())], ["key", "page_id", "file", "offset", "length"])

    kind = "key string, page_id long, file string, offset long, length long"
    written = stored(ranged.sortWithinPartitions(*order, "_salt").drop("_salt").mapInArrow(write, kind), "warc-index")
    tops = sorted((_key(r["key"], r["page_id"]), (r["file"], r["offset"], r["length"])) for r in written.collect())
    return CaptureIndex(path, archive, [k for k, _ in tops], [f for _, f in tops])


class _Reader:
    """Looks keys up in an index; keeps the last directory, block and archive file open."""

    def __init__(self, index: CaptureIndex):
        self.index = index
        self.store, self.folder = store_of(index.path)
        self.archive, self.archive_folder = store_of(index.archive)
        self.directory: tuple[int, list[Key], list] = (-1, [], [])
        self.block: tuple[tuple[int, int], list[Key], list] = ((-1, -1), [], [])
        self.open: tuple[str, pa.NativeFile | None] = ("", None)

    def _range(self, name: str, offset: int, length: int) -> bytes:
        with self.store.open_input_file(f"{self.folder}/{name}") as f:
            return f.read_at(length, offset)

    def _directory(self, shard: int) -> tuple[list[Key], list]:
        if self.directory[0] != shard:
            rows = json.loads(zlib.decompress(self._range(*self.index.files[shard])))
            self.directory = shard, [_key(*r[:2]) for r in rows], rows
        return self.directory[1:]

    def _block(self, shard: int, k: int) -> tuple[list[Key], list]:
        if self.block[0] != (shard, k):
            row = self._directory(shard)[1][k]
            rows = [json.loads(x) for x in zlib.decompress(self._range(self.index.files[shard][0], row[2], row[3])).split(b"\n")]
            self.block = (shard, k), [_key(*r[:2]) for r in rows], rows
        return self.block[1:]

    def entries(self, key: Key) -> Iterator[tuple[str, int, int]]:
        """Archive places of every capture of a key; equal keys may go on in later blocks and files."""
        first = self.index.first
        shard = max(bisect_left(first, key) - 1, 0)
        while shard < len(first) and first[shard] <= key:
            starts, rows = self._directory(shard)
            k = max(bisect_left(starts, key) - 1, 0)
            while k < len(starts) and starts[k] <= key:
                keys, found = self._block(shard, k)
                i = bisect_left(keys, key)
                while i < len(keys) and keys[i] == key:
                    yield tuple(found[i][2:])
                    i += 1
                k += 1
                starts, rows = self._directory(shard)
            shard += 1

    def record(self, name: str, offset: int, length: int) -> bytes:
        if self.open[0] != name:
            if self.open[1] is not None:
                self.open[1].close()
            self.open = name, self.archive.open_input_file(f"{self.archive_folder}/{name}")
        return gzip.decompress(self.open[1].read_at(length, offset))


def read_captures(keys: DataFrame, index: CaptureIndex, *, payload: bool = True, n_tasks: int | None = None) -> DataFrame:
    """Captures of the distinct (key, page_id) rows of keys, read from the archive through the index.

    n_tasks: ranges of keys to read in; by default Spark decides by the size of the keys, which says little of the records.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(index)
        for batch in batches:
            wanted = batch.to_pydict()
            for at in range(0, batch.num_rows, 512):
                places = [p for k, i in zip(wanted["key"][at : at + 512], wanted["page_id"][at : at + 512]) for p in reader.entries(_key(k, i))]
                rows = [parse(reader.record(*p)) for p in sorted(places)]
                if not payload:
                    rows = [r | {"payload": None} for r in rows]
                if rows:
                    yield from pa.Table.from_pylist(rows, _CAPTURE_SCHEMA).to_batches()

    order = ["key", "page_id"]
    asked = keys.select(*order).distinct()
    asked = (asked.repartitionByRange(n_tasks, *order) if n_tasks else asked.repartitionByRange(*order)).sortWithinPartitions(*order)
    return asked.mapInArrow(read, CAPTURE)


def archive_and_read(pages: DataFrame, path: str | None = None, *, payload: bool = True) -> DataFrame:
    """Write pages to WARC files under path (default: scratch), index them and read every capture back."""
    spark: SparkSession = pages.sparkSession
    path = path or scratch(spark, "warc")
    captures = write_archive(pages, f"{path}/archive")
    index = build_index(captures, f"{path}/index", f"{path}/archive")
    size = captures.agg(F.sum("length")).first()[0] or 0
    return read_captures(captures, index, payload=payload, n_tasks=1 + size // READ_BYTES)
