"""WARC archives with a two-level capture index.

Writing is plain Spark: each page becomes one WARC/1.1 record made of string
expressions, and the text writer ends every record with CRLF CRLF, so executors
commit archive files of bounded size straight to the shared folder.  Of records
with equal payloads the one with the smallest page_id is a response; the others
are revisits without a payload.  Which pages those are is settled on (digest,
page_id) rows alone, with a pre-aggregated minimum; page contents are never
shuffled while the revisits are few enough to broadcast.

The index has two levels.  Captures are sorted by reversed-host URL key over the
whole corpus and cut into compressed blocks of BLOCK lines, which each task appends to
one file; the sparse directory has one row a block: its first and last key
and its byte range.  ``lookup`` prunes the sorted directory by its stored statistics,
binary-searches what is left for the blocks that can hold a key, reads those blocks by their
ranges, binary-searches their lines, and ``read_captures`` reads the records found by their
ranges.  ``read_all`` goes through every block the same way and reads every record by
its range; neighbouring ranges are read at once.  No file is ever read whole: files are
opened by ``opener``, by default pyarrow's file systems (local, HDFS, S3, GCS, Azure by URI).

Defined results: null html is an empty payload; a null URL has the key ``-``; equal
page_ids with equal payloads are one capture each, all of the same type; a row
without a page_id is a response of its own. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.llm.common import BROADCAST_ROWS, new_path, ship, small, stash

MIN_BYTES, BLOCK, DATE = 0, 512, "2024-01-01T00:00:00Z"
#: Records of an archive file, bytes of a read that joins neighbouring ranges or goes through headers, and files a task keeps open.
RECORDS, READ_BYTES, OPEN_FILES = 2048, 1 << 22, 8
#: RFC 4648 base32, and the digits that conv() gives for base 32: fixed values.
_CONV, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"


def payload_digest(html: Column) -> Column:
    """Upper-case base32 of the SHA-1 of the UTF-8 bytes: 40 bits at a time give 8 digits."""
    sha = F.sha1(F.encode(html, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _CONV, _BASE32)


def url_key(url: Column) -> Column:
    """Reversed-host key: ``http://a.b.org:80/x?y#z`` is ``org,b,a)/x?y``; lower-case host, no scheme, port or fragment."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^.*@|:\d*$", ""))
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.regexp_replace(F.when(host == "", "-").otherwise(key), r"\s", "%20")


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def _record(first: Column) -> Column:
    """The record of a page without the final CRLF CRLF; first: page_id of the response it revisits, or null."""
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"))
    body = F.when(F.col("is_first"), F.concat(head, F.col("html"))).otherwise(head)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("is_first"), "response").otherwise("revisit")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("is_first"), "").otherwise(
            F.concat(line("WARC-Refers-To", _urn(first)), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))
        ),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> None:
    """Write one record for each row of pages(page_id, url, html)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "digest": payload_digest(F.col("html"))})
    keys = stash(rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", "digest"), "payload-digests")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("last > first")
    # Only payloads that several pages share can make revisits; all others are responses.
    shared = stash(firsts.select("digest", "first"), "shared-payloads")
    n = shared.count()
    rows = rows.join(small(shared, n, BROADCAST_ROWS // 2), "digest", "left")
    first = F.when(F.col("payload_bytes") >= min_bytes, F.col("first"))
    rows = rows.withColumn("is_first", first.isNull() | F.col("page_id").isNull() | (F.col("page_id") == first))
    rows.select(_record(F.col("first")).alias("value")).write.mode("append").option("lineSep", _END).option("maxRecordsPerFile", RECORDS).text(folder)


def arrow_file(path: str) -> pa.NativeFile:
    """A file opened for reads at any byte; path: a URI."""
    from pyarrow import fs

    place, inner = fs.FileSystem.from_uri(_uri(path))
    return place.open_input_file(inner)


def _uri(path: str) -> str:
    """The path as pyarrow names it: Spark writes file:/x for file:///x, and s3a for s3."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return re.sub(r"^s3[an]://", "s3://", path)


class _Ranges:
    """Byte ranges of files; the last few files stay open. spent: an accumulator that counts the bytes read."""

    def __init__(self, opener, spent=None) -> None:
        self.opener, self.spent, self.files = opener, spent, {}

    def file(self, path: str):
        if path not in self.files:
            if len(self.files) >= OPEN_FILES:
                self.files.pop(next(iter(self.files))).close()
            self.files[path] = self.opener(path)
        return self.files[path]

    def read(self, path: str, at: int, length: int) -> bytes:
        source = self.file(path)
        source.seek(at)
        data = source.read(length)
        if self.spent is not None:
            self.spent.add(len(data))
        return data


def _header(data: memoryview) -> tuple[dict[str, str], int] | None:
    """Headers of the record that data starts with, and where its block starts; None if the headers go on beyond data."""
    text = bytes(data)
    if not text.startswith(b"WARC/"):
        raise ValueError("no record starts here")
    stop = text.find(b"\r\n\r\n")
    if stop < 0:
        return None
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in text[:stop].decode().split("\r\n")[1:])}, stop + 4


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(m[1]) if m else None


def _scan(opener):
    """Archive files to captures: where each record is. Only headers are looked at; what a read doesn't hold of a long record is skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _Ranges(opener)
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                at, base, data, out = 0, 0, memoryview(b""), []
                while at < size:
                    window = 2048
                    while True:
                        if at + window > base + len(data) < size:
                            base, data = at, memoryview(source.read(path, at, max(READ_BYTES, window)))
                        head = _header(data[at - base : at - base + window])
                        if head is not None:
                            break
                        if at + window >= size:
                            raise ValueError(f"no record at byte {at} of {path}")
                        window *= 4
                    after = at + head[1] + int(head[0]["content-length"]) + 4
                    out.append((head[0].get("warc-target-uri", ""), _page(head[0]["warc-record-id"]), path.rsplit("/", 1)[1], at, after - at))
                    at = after
                yield pa.record_batch(list(map(pa.array, zip(*out, strict=True))) if out else [[]] * 5, schema=_SCANNED)

    return run


_SCANNED = pa.schema([("url", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def scan_archives(spark: SparkSession, folder: str, opener=arrow_file) -> DataFrame:
    """(url, page_id, file, offset, length) of every record in the archives of a folder; file: the name inside it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select("path", "length").mapInArrow(_scan(opener), "url string, page_id long, file string, offset long, length long")


def _pack(block: int, folder: str):
    """Sorted captures to compressed blocks, one after the other in a file of the task's attempt. A block never spans partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held: list[tuple] = []
        rows: list[tuple] = []
        path, sink, at = f"{folder}/blocks-{uuid.uuid4().hex}", None, 0

        def pack(lines: list[tuple]) -> None:
            nonlocal sink, at
            if sink is None:
                place, inner = fs.FileSystem.from_uri(_uri(path))
                place.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                sink = place.open_output_stream(inner)
            data = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), 6)
            sink.write(data)
            rows.append((lines[0][0], lines[-1][0], len(lines), path, at, len(data)))
            at += len(data)

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= block:
                pack(held[:block])
                held = held[block:]
        if held:
            pack(held)
        if sink is not None:
            # The directory names the file only once it is complete; what a lost attempt wrote is named nowhere.
            sink.close()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIRECTORY.types, strict=True)], schema=_DIRECTORY)

    return run


_DIRECTORY = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("n", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def build_index(captures: DataFrame, block: int = BLOCK) -> DataFrame:
    """The sparse directory (first_key, last_key, n, file, offset, length), a row for each compressed block, in key order; blocks and directory are in the shared folder.
    Ties in the key are cut by page_id and place, so a hot host is as many ranges."""
    keyed = captures.select(url_key(F.col("url")).alias("key"), F.col("page_id"), "file", "offset", "length")
    order = ["key", "page_id", "file", "offset"]
    folder = new_path(captures.sparkSession, "capture-blocks")
    blocks = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack(block, folder), "first_key string, last_key string, n int, file string, offset long, length long")
    return stash(blocks, "capture-directory")


def _search(keys: list[str]):
    """Blocks that can hold one of the sorted keys, by binary search: a run of directory rows in key order against the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = batch.column("first_key").to_pylist(), batch.column("last_key").to_pylist()
            found: set[int] = set()
            start = 0
            while start < len(first):  # files are in key order, but several may follow each other in a task
                stop = start + 1
                while stop < len(first) and first[stop] >= last[stop - 1]:
                    stop += 1
                for key in keys:
                    found.update(range(bisect.bisect_left(last, key, start, stop), bisect.bisect_right(first, key, start, stop)))
                start = stop
            yield batch.take(pa.array(sorted(found), pa.int64()))

    return run


def _unpack(opener, keys: list[str] | None = None, spent=None):
    """The lines of blocks; of sorted keys, those found by binary search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _Ranges(opener, spent)
        for batch in batches:
            for path, at, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                rows = [x.split("\t") for x in zlib.decompress(source.read(path, at, length)).decode().split("\n")]
                if keys is not None:
                    names = [r[0] for r in rows]
                    rows = [r for key in keys for r in rows[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]]
                if rows:
                    key, page, file, offset, size = zip(*rows, strict=True)
                    yield pa.record_batch(
                        [pa.array(key), pa.array([None if p == "None" else int(p) for p in page], pa.int64()), pa.array(file), pa.array(map(int, offset), pa.int64()), pa.array(map(int, size), pa.int64())],
                        ["key", "page_id", "file", "offset", "length"],
                    )

    return run


_CAPTURE = "key string, page_id long, file string, offset long, length long"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def blocks_of(index: DataFrame, urls: list[str]) -> tuple[DataFrame, list[str]]:
    """The directory rows of blocks that can hold one of the URLs, and the URLs' sorted keys. The list of URLs is the caller's, and small."""
    spark = index.sparkSession
    keys = sorted(r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_key(F.col("u"))).distinct().collect())
    if not keys:
        return index.limit(0), keys
    # Bounds of all keys reach the statistics of the stored directory.
    return index.where((F.col("first_key") <= keys[-1]) & (F.col("last_key") >= keys[0])).mapInArrow(_search(keys), index.schema), keys


def lookup(index: DataFrame, urls: list[str], opener=arrow_file, spent=None) -> DataFrame:
    """Captures of a list of URLs: the directory is searched for blocks, and only those are read; spent: an accumulator of the bytes read."""
    blocks, keys = blocks_of(index, urls)
    return blocks.mapInArrow(_unpack(opener, keys, spent), _CAPTURE)


def _record_of(part: memoryview, payloads: bool) -> tuple:
    head, body = _header(part[:2048]) or _header(part)
    digest, size, payload = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"]), None
    if head["warc-type"] == "response":
        block = part[body : body + int(head["content-length"])]
        text = block[bytes(block[:4096]).index(b"\r\n\r\n") + 4 :]
        if (found := base64.b32encode(hashlib.sha1(text).digest()).decode()) != digest or len(text) != size:
            raise ValueError(f"record of page {head['warc-record-id']} is damaged: {found}")
        payload = bytes(text) if payloads else None
    return _page(head["warc-record-id"]), size, digest, head["warc-type"], _page(head["warc-refers-to"]) if "warc-refers-to" in head else None, head.get("warc-target-uri", ""), payload


def _read(opener, payloads: bool, spent):
    """Records at ranges sorted by file and offset. Neighbouring ranges are read at once, up to READ_BYTES; a longer record by itself."""

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        held: list[tuple[int, int]] = []
        name = None
        for path, at, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
            if held and (path != name or at != sum(held[-1]) or at + length - held[0][0] > READ_BYTES):
                yield name, held
                held = []
            name = path
            held.append((at, length))
        if held:
            yield name, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _Ranges(opener, spent)
        for batch in batches:
            for path, places in runs(batch):
                start = places[0][0]
                data = memoryview(source.read(path, start, sum(places[-1]) - start))
                out = [_record_of(data[at - start : at - start + length], payloads) for at, length in places]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _READ, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"])

    return run


_READ = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())


def read_captures(captures: DataFrame, folder: str, payloads: bool = True, opener=arrow_file, spent=None) -> DataFrame:
    """The records at the byte ranges of captures(file, offset, length), digests checked. Only those ranges of the archives in folder are read."""
    ranges = captures.select(F.concat(F.lit(folder + "/"), "file").alias("file"), "offset", "length")
    return ranges.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_read(opener, payloads, spent), _RECORD)


def archive(pages: DataFrame, min_bytes: int = MIN_BYTES, block: int = BLOCK) -> tuple[str, DataFrame]:
    """Write, index, and return the archive folder and the index, its directory."""
    spark = pages.sparkSession
    ship(spark)
    folder = new_path(spark, "warc")
    write_archives(pages, folder, min_bytes)
    return folder, build_index(scan_archives(spark, folder), block)


def read_all(index: DataFrame, folder: str, payloads: bool = True, opener=arrow_file) -> DataFrame:
    """Every record, through every index block."""
    return read_captures(index.mapInArrow(_unpack(opener), _CAPTURE), folder, payloads, opener)
