"""WARC archives with a two-level capture index.

Pages become WARC/1.1 records, one gzip member each, in archive files that the
tasks write to the shared folder. Of records with equal payloads of at least
``LEAST`` bytes, the one with the smallest page_id is a response and the others
are revisits without a body. Only ids, urls and digests are grouped to find
them; html meets its decision under digest, id and url, so pages of equal
payloads don't meet in one task.

The index has two levels. Lines (key: reversed host, then path) are sorted by
range into blocks of ``LINES`` lines, compressed one by one. Each index file
ends in a sparse directory: an entry for each of its blocks, with its first and
last key and its place, and the places of the entries. A lookup finds the files
by their outer keys (one row a file, as many as there were tasks), binary-searches
the file's directory by range reads, reads the blocks that can hold the key, and
reads the records by byte range. A revisit's line holds the place of the record
that it refers to, whatever its url. Reading everything back goes the same way:
directory entries are dealt to tasks, blocks give lines, lines are sorted by
place, and neighbouring records are read in one range.

A task names its files at random and returns their names, so files of lost or
repeated attempts are never referred to.

Defined results: null html is an empty payload; a page without url or id has a
record without that header and the empty key; pages without an id are never
referred to, and are responses unless another page has their payload; rows
that share the smallest id and the payload are all responses; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreseek.llm.common import join_hot, pieces
from loreseek.sources.shared import Scratch

LEAST = 100
LINES = 512
ROLL = 64 << 20  # bytes of an archive file, about
RANGE = 4 << 20  # bytes of neighbouring records that are read at once
_PLACE = "file string, at long, size long"
_ENTRY = f"key string, page_id long, url string, type string, digest string, refers_to long, {_PLACE}"
_LINE = f"{_ENTRY}, response struct<file:string,at:long,size:long>"
_FILES = "first_key string, last_key string, blocks long, lines long, file string, entries_at long, places_at long"


def surt(url: str | None) -> str:
    """The key of a url: host labels in reverse order, then port, path and query; letters of the host lower-cased."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else "") + ")" + path


def decided(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, refers_to (null: a response), and the url and id of the record that is referred to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n_bytes"))
    narrow = scratch.table(hashed.filter(F.col("n_bytes") >= LEAST).select("page_id", "url", "digest"), "digests")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first")
    shared = scratch.table(narrow.groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1"), "shared")
    revisits = join_hot(narrow, shared, "digest").filter(F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    revisits = revisits.select(F.col("digest").alias("d"), F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("response_url")).distinct()
    same = (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u"))
    return hashed.join(scratch.table(revisits, "revisits"), same, "left").select("page_id", "url", "html", "digest", "refers_to", "response_url")


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The id of a page's record; equal rows are one capture."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


_DATE = "2024-01-01T00:00:00Z"
_uri = lambda url: quote(url, safe=":/?#[]@!$&()*+,;=%~")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, response_url: str | None = None) -> bytes:
    """A WARC record; a revisit has the payload's digest and length but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {_DATE}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, response_url, digest)}", f"WARC-Refers-To-Date: {_DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
        if response_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(response_url)}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record, by lower-case name, and its payload (empty for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a folder that is named as Hadoop names it; a scheme that archives can't be written to is refused at once."""
    scheme, colon, rest = folder.partition("://")
    aliases = {"s3a": "s3", "s3n": "s3"}
    try:
        return fs.FileSystem.from_uri(aliases.get(scheme, scheme) + colon + rest)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as no:
        raise ValueError(f"archives need a folder on a file, hdfs, s3a, gs or abfss store that pyarrow can open, not {folder}") from no


class _Files:
    """Rolling files of one task below a folder."""

    def __init__(self, folder: str, suffix: str, roll: int | None = None) -> None:
        self.store, self.folder = opened(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.suffix, self.roll, self.out, self.name, self.at = suffix, ROLL if roll is None else roll, None, "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > self.roll:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.out = None


def _rows(rows: list[tuple], shape: str) -> pa.RecordBatch:
    place = pa.struct([("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
    fields = [x.split(" ") for x in shape.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64()}.get(k, place) for _, k in fields]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in fields])


def write_archives(pages: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Index entries of the archives that evaluating the result writes; evaluate it once, into a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, ".warc.gz")
        for batch in pieces(batches, 8 << 20, "html"):
            rows = []
            for page_id, url, html, digest, refers_to, response_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = files.add(_gzip(record(page_id, url, html.encode(), digest, refers_to, response_url)))
                rows.append((surt(url), page_id, url, "response" if refers_to is None else "revisit", digest, refers_to, *place))
            yield _rows(rows, _ENTRY)
        files.close()

    return decided(pages, scratch).mapInArrow(run, _ENTRY)


def with_responses(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Written ``entries`` with the place of the record that each revisit refers to."""
    revisits, others = entries.filter("type = 'revisit'"), entries.filter("type <> 'revisit'")
    if revisits.isEmpty():
        return others.withColumn("response", F.lit(None).cast("struct<file:string,at:long,size:long>"))
    many = revisits.groupBy("digest", "refers_to").agg(F.count("*").alias("n"))
    places = others.groupBy("digest", F.col("page_id").alias("refers_to")).agg(F.min(F.struct("file", "at", "size")).alias("response"))
    found = scratch.table(many.join(places, ["digest", "refers_to"]).select("digest", "response", "n"), "responses")  # a digest has one referred id
    return join_hot(revisits, found, "digest").select(*entries.columns, "response").union(others.withColumn("response", F.lit(None)))


def write_index(lines: DataFrame, folder: str) -> DataFrame:
    """A row for each index file that evaluating the result writes: sorted, compressed blocks, then their directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, directory = _Files(folder, ".cdx", 1 << 62), [], []

        def block(lines: list[tuple]) -> None:
            packed = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            directory.append((lines[0][0], lines[-1][0], len(lines), *files.add(packed)[1:]))

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= LINES:
                block(held[:LINES])
                held = held[LINES:]
        if held:
            block(held)
        if directory:
            places = [files.add(json.dumps(x).encode())[1] for x in directory]
            end = files.at
            name = files.add(np.array([*places, end], "<i8").tobytes())[0]
            yield _rows([(directory[0][0], directory[-1][1], len(directory), sum(x[2] for x in directory), name, places[0], end)], _FILES)
        files.close()

    order = ["key", "page_id", "file", "at"]
    names = [x.split(" ")[0] for x in _LINE.split(", ")]
    return lines.select(*names).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _FILES)


class Directory:
    """The directory of one index file, read by ranges."""

    def __init__(self, file: pa.NativeFile, blocks: int, places_at: int) -> None:
        self.file, self.many = file, blocks
        self.places = np.frombuffer(file.read_at(8 * (blocks + 1), places_at), "<i8")
        self.read = 0  # entries that were read

    def entry(self, k: int) -> tuple:
        """(first key, last key, lines, place, size) of block k."""
        self.read += 1
        return tuple(json.loads(self.file.read_at(int(self.places[k + 1] - self.places[k]), int(self.places[k]))))

    def block(self, entry: tuple) -> list[list]:
        return [json.loads(x) for x in zlib.decompress(self.file.read_at(entry[4], entry[3])).decode().split("\n")]

    def lines(self, key: str) -> Iterator[list]:
        """The lines of a key, block by block: binary search for the first block that ends at the key or later, then within each block."""
        low, high = 0, self.many
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.entry(middle)[1] < key else (low, middle)
        while low < self.many and (entry := self.entry(low))[0] <= key:
            block = self.block(entry)
            yield from block[bisect.bisect_left(block, key, key=lambda x: x[0]) : bisect.bisect_right(block, key, key=lambda x: x[0])]
            low += 1


def read_lines(files: DataFrame, folder: str) -> DataFrame:
    """All lines of the index files: directory entries are dealt to tasks, which read their blocks by range."""
    entry = "file string, blocks long, places_at long, k long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        at, handle, directory = None, None, None
        for batch in batches:
            for file, blocks, places_at, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != at:
                    if handle is not None:
                        handle.close()
                    at, handle = file, store.open_input_file(f"{path}/{file}")
                    directory = Directory(handle, blocks, places_at)
                rows = directory.block(directory.entry(k))
                yield _rows([(*x[:9], x[9] and dict(zip(("file", "at", "size"), x[9].values(), strict=True))) for x in rows], _LINE)
        if handle is not None:
            handle.close()

    dealt = files.select("file", "blocks", "places_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))
    return dealt.repartitionByRange("file", "k").sortWithinPartitions("file", "k").select(*[x.split(" ")[0] for x in entry.split(", ")]).mapInArrow(run, _LINE)


def ranges(places: Iterator[tuple[str, int, int]], folder: str) -> Iterator[bytes]:
    """The bytes of places that are sorted by file and position; neighbours are read together."""
    store, path = opened(folder)
    at, handle, held = None, None, []

    def close() -> Iterator[bytes]:
        if held:
            begin = held[0][0]
            data = handle.read_at(held[-1][0] + held[-1][1] - begin, begin)
            yield from (data[a - begin : a - begin + n] for a, n in held)
            held.clear()

    for file, begin, size in places:
        if file != at or held and (begin != held[-1][0] + held[-1][1] or begin + size - held[0][0] > RANGE):
            yield from close()
        if file != at:
            if handle is not None:
                handle.close()
            at, handle = file, store.open_input_file(f"{path}/{file}")
        held.append((begin, size))
    yield from close()
    if handle is not None:
        handle.close()


def read_records(lines: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the record of each index line.

    The digest of a response is computed from the payload that was read; it must be the one in the header. Header and line must agree.
    """
    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            file, at, size, page_id, kind = (c.to_pylist() for c in batch.columns)
            rows = []
            for name, place, line, data in zip(file, at, zip(page_id, kind, strict=True), ranges(zip(file, at, size, strict=True), folder), strict=True):
                headers, payload = parsed(zlib.decompress(data, 31))
                digest, many = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
                own, refers_to = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                row = own and int(own), many, digest, headers["warc-type"], refers_to and int(refers_to)
                if row[3] == "response" and (len(payload) != many or hashlib.sha256(payload).hexdigest() != digest) or (row[0], row[3]) != line:
                    raise ValueError(f"{name}: the record at {place} is not the one that was written")
                rows.append(row)
            yield _rows(rows, shape)

    return lines.select("file", "at", "size", "page_id", "type").repartitionByRange("file", "at").sortWithinPartitions("file", "at").mapInArrow(run, shape)


def members(folder: str, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive file without an index, read from start to end in parts."""
    store, folder = opened(folder)
    with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
        unpacker, data, rest = zlib.decompressobj(31), [], b""
        while chunk := rest or stream.read(1 << 20):
            data.append(unpacker.decompress(chunk))
            rest = unpacker.unused_data
            if unpacker.eof:
                yield parsed(b"".join(data))
                unpacker, data = zlib.decompressobj(31), []


class Captures:
    """An archive with its index: the table ``files`` of the index files, and the folder of all files."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.scratch = Scratch(spark, "warc")
        self.folder = folder or f"{self.scratch.path}/files"
        opened(self.folder)

    def write(self, pages: DataFrame) -> Captures:
        entries = self.scratch.table(write_archives(pages, self.folder, self.scratch), "entries")
        self.files = self.scratch.table(write_index(with_responses(entries, self.scratch), self.folder), "index")
        return self

    def records(self) -> DataFrame:
        """All records, read back through the index."""
        return read_records(self.scratch.table(read_lines(self.files, self.folder), "lines"), self.folder)

    def lookup(self, url: str) -> Iterator[tuple[dict[str, str], bytes]]:
        """The captures of one url, by page_id, read one after the other; revisits come with the payload that they refer to."""
        key = surt(url)
        store, folder = opened(self.folder)
        for row in self.files.filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("first_key", "last_key").toLocalIterator():
            with store.open_input_file(f"{folder}/{row['file']}") as f:
                for line in Directory(f, row["blocks"], row["places_at"]).lines(key):
                    if line[2] == url:
                        headers, payload = self._read(store, folder, *line[6:9])
                        yield headers, self._read(store, folder, *line[9].values())[1] if line[9] else payload

    @staticmethod
    def _read(store: fs.FileSystem, folder: str, file: str, at: int, size: int) -> tuple[dict[str, str], bytes]:
        with store.open_input_file(f"{folder}/{file}") as f:
            return parsed(zlib.decompress(f.read_at(size, at), 31))


def through_archives(pages: DataFrame) -> DataFrame:
    """Writes the archives and the index of ``pages`` (page_id, url, html), and reads all records back through the index."""
    captures = Captures(pages.sparkSession).write(pages.select("page_id", "url", "html"))
    return captures.records()


#: The same in DuckDB SQL.
WARC_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM q
"""
