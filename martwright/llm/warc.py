"""Web archives with a two-level capture index.

Every task writes its pages as an archive of one gzip member per record into the shared
folder. The index lines, keyed by the URL with its host reversed, are range-partitioned
and sorted; each partition becomes a file of compressed blocks that ends with a sparse
directory of the blocks' first lines. A lookup finds the file by its first line, binary-
searches the directory, reads one block, binary-searches that, and then reads the
record's bytes. File names are new for every attempt, and only files that a finished
task reported are ever read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from martwright.llm.common import stored
from martwright.session import shared_folder

LEAST_SHARED = 1000
# Lines of an index block, bytes of an archive, bytes of a range read and of a gap it may bridge.
BLOCK_LINES, ARCHIVE_BYTES, READ_BYTES, READ_GAP = 500, 1 << 28, 1 << 23, 1 << 16
_GZIP, _LEVEL = 31, 3
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_NONE = "null"


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels from the right, then the rest."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return f"){url or ''}"
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = rest[:end].rpartition("@")[2].lower()
    host, colon, port = host.partition(":")
    default = {"http": "80", "https": "443"}.get(scheme.lower())
    return ",".join(reversed(host.split("."))) + (f":{port}" if colon and port != default else "") + ")" + rest[end:]


def _uri(url: str | None) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{_NONE if page_id is None else page_id}>",
        f"WARC-Target-URI: {_uri(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    packer = zlib.compressobj(_LEVEL, wbits=_GZIP)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if number == _NONE else int(number)


def _parsed(data: bytes) -> tuple[int | None, str, int | None, str, int | None]:
    """page_id, type, payload bytes (none of a revisit), digest, refers_to of a record."""
    whole = zlib.decompress(data, wbits=_GZIP)
    head, _, rest = whole.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    page, digest = _page(named["WARC-Record-ID"]), named["WARC-Payload-Digest"].removeprefix("sha1:")
    if named["WARC-Type"] == "revisit":
        return page, "revisit", None, digest, _page(named["WARC-Refers-To"])
    payload = block.partition(b"\r\n\r\n")[2]
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record {page}: payload does not have its digest")
    return page, "response", len(payload), digest, None


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class _Writer:
    """A file that is replaced by the next one when it is large enough."""

    def __init__(self, folder: str, suffix: str):
        self.files, self.folder = _opened(folder)
        self.suffix, self.out, self.name, self.size = suffix, None, "", 0

    def write(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.size >= ARCHIVE_BYTES:
            self.close()
            self.name, self.size = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.out.write(data)
        self.size += len(data)
        return self.name, self.size - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


_LINES = "key string, page long, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Write one record per page below ``folder``; returns the unsorted index lines (stored).

    Of records with equal payloads of at least ``least_shared`` bytes the one with the
    largest page_id holds the payload, the others only refer to it.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= least_shared).groupBy("digest").agg(F.max("page").alias("original"), F.count("*").alias("rows"))
    shared = shared.where("rows > 1").select("digest", "original")
    marked = rows.join(shared, "digest", "left")
    refers = F.when(F.col("page").isNull() | (F.col("page") < F.col("original")), F.col("original"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, ".warc.gz")
        try:
            for batch in batches:
                lines = []
                for page, url, data, digest, original in zip(*(c.to_pylist() for c in batch.columns)):
                    record = _record(page, url, data, digest, original)
                    lines.append((surt(url), page, *writer.write(record), len(record)))
                if lines:
                    yield pa.record_batch([pa.array(c) if i != 1 else pa.array(c, pa.int64()) for i, c in enumerate(zip(*lines))], names=["key", "page", "file", "offset", "length"])
        finally:
            writer.close()

    return stored(marked.select("page", "url", "payload", "digest", refers.alias("original")).mapInArrow(write, _LINES), "captures")


def write_index(lines: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted index; returns one row per index file: first key and page, directory place.

    The rows number at most the partitions of the sort. Pages without an id sort first.
    """
    order = [F.asc("key"), F.asc_nulls_first("page"), F.asc("file"), F.asc("offset")]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, held, directory = _Writer(folder, ".cdx"), [], []
        name, end = "", 0

        def block() -> None:
            nonlocal name, end
            data = zlib.compress("\n".join(map(json.dumps, held)).encode())
            name, start = writer.write(data)
            end = start + len(data)
            directory.append([*held[0][:2], start, len(data)])
            held.clear()

        def seal() -> pa.RecordBatch:
            data = zlib.compress(json.dumps(directory).encode())
            first = directory[0]
            writer.out.write(data)
            writer.close()
            row = pa.record_batch([[first[0]], pa.array([first[1]], pa.int64()), [name], [end], [len(data)]], names=["key", "page", "file", "offset", "length"])
            directory.clear()
            return row

        try:
            for batch in batches:
                for line in zip(*(c.to_pylist() for c in batch.columns)):
                    held.append(list(line))
                    if len(held) == block_lines:
                        block()
                        if end >= ARCHIVE_BYTES:
                            yield seal()
            if held:
                block()
            if directory:
                yield seal()
        finally:
            writer.close()

    return stored(ordered.mapInArrow(write, _LINES), "index")


def _rank(key: str, page: int | None) -> tuple[str, int]:
    # Python compares strings by code point, as Spark does by their UTF-8 bytes.
    return key, -(1 << 63) - 1 if page is None else page


class _Index:
    """One index file opened for lookups; keeps the block read last."""

    def __init__(self, files: pafs.FileSystem, path: str, offset: int, length: int):
        self.file = files.open_input_file(path)
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, offset)))
        self.firsts = [_rank(key, page) for key, page, *_ in self.directory]
        self.at, self.lines, self.ranks = -1, [], []

    def block(self, number: int) -> None:
        if number != self.at:
            _, _, offset, length = self.directory[number]
            text = zlib.decompress(self.file.read_at(length, offset)).decode()
            self.lines = [json.loads(line) for line in text.split("\n")]
            self.at, self.ranks = number, [_rank(line[0], line[1]) for line in self.lines]

    def find(self, key: str, page: int | None) -> Iterator[list]:
        """Lines with this key and page; equal lines may fill several blocks."""
        wanted = _rank(key, page)
        number = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while number < len(self.directory) and self.firsts[number] <= wanted:
            self.block(number)
            for i in range(bisect.bisect_left(self.ranks, wanted), len(self.lines)):
                if self.ranks[i] != wanted:
                    return
                yield self.lines[i]
            number += 1


def look_up(wanted: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """Places (page, file, offset, length) of the captures with the ``url`` and ``page`` of each distinct row."""
    shards = sorted((_rank(r["key"], r["page"]), r["file"], r["offset"], r["length"]) for r in index.collect())
    known = wanted.sparkSession.sparkContext.broadcast(shards)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [s[0] for s in known.value]
        for batch in batches:
            out = []
            for url, page in zip(*(c.to_pylist() for c in batch.columns)):
                key = surt(url)
                # Equal lines may run over several files: all that can hold them are asked.
                first = max(0, bisect.bisect_left(firsts, _rank(key, page)) - 1)
                out += [(key, page, n) for n in range(first, max(first + 1, bisect.bisect_right(firsts, _rank(key, page))))]
            if out and firsts:
                keys, ids, numbers = zip(*out)
                yield pa.record_batch([pa.array(keys), pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["key", "page", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        opened, number = None, -1
        for batch in batches:
            out = []
            for key, page, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != number:
                    _, name, offset, length = known.value[shard]
                    opened, number = _Index(files, f"{root}/{name}", offset, length), shard
                out += [line[1:] for line in opened.find(key, page)]
            if out:
                ids, names, offsets, lengths = zip(*out)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(names), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["page", "file", "offset", "length"])

    asked = wanted.select("url", "page").mapInArrow(assign, "key string, page long, shard int").distinct()
    asked = asked.repartition("shard").sortWithinPartitions("shard", "key", "page")
    return asked.mapInArrow(search, "page long, file string, offset long, length long")


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Records at the places: page, kind, bytes (null of a revisit), digest, original.

    The places of an archive are read in order; neighbouring ones share a range read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        name, source = None, None
        for batch in batches:
            out, run = [], []

            def fetch() -> None:
                if run:
                    start = run[0][0]
                    data = source.read_at(run[-1][0] + run[-1][1] - start, start)
                    out.extend(_parsed(data[o - start : o - start + n]) for o, n in run)
                    run.clear()

            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name or run and (offset - run[-1][0] - run[-1][1] > READ_GAP or offset + length - run[0][0] > READ_BYTES):
                    fetch()
                if file != name:
                    name, source = file, files.open_input_file(f"{root}/{file}")
                run.append((offset, length))
            fetch()
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=["page", "kind", "bytes", "digest", "original"])

    ordered = places.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, "page long, kind string, bytes long, digest string, original long")


def archive_round_trip(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Write pages as archives, then read every capture back through the index.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. A
    null html is an empty payload; a null or odd url is kept in the index as it is; rows
    that share the largest page_id of their payload are all responses; a null page_id
    refers to an equal payload that has one and is a response otherwise; repeated rows
    are captures of their own; an empty table gives no rows; further columns are not
    looked at. The size of a revisit's payload is that of the response it refers to.
    """
    folder = f"{shared_folder(pages.sparkSession)}/archive-{uuid.uuid4().hex[:12]}"
    files, root = _opened(folder)
    files.create_dir(root, recursive=True)
    index = write_index(write_archives(pages, folder, least_shared), folder)
    wanted = pages.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page"))
    records = stored(read_records(look_up(wanted, index, folder), folder), "records")
    sizes = records.where("kind = 'response'").select(F.col("page").alias("original"), F.col("digest"), F.col("bytes").alias("full")).distinct()
    joined = records.join(sizes, ["original", "digest"], "left")
    return joined.select(
        F.col("page").alias("page_id"), F.coalesce("bytes", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("original").alias("refers_to")
    )


def oracle(least_shared: int = LEAST_SHARED) -> str:
    """DuckDB statement for ``archive_round_trip``."""
    return f"""
    WITH rows AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    digests AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM rows),
    marked AS (SELECT *, payload_bytes >= {least_shared} AND page_id < max(page_id) OVER (PARTITION BY payload_digest) AS again,
                      max(page_id) OVER (PARTITION BY payload_digest) AS original FROM digests)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN again THEN original END AS refers_to FROM marked"""
