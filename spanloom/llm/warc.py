"""WARC archives: a writer with one gzip member for each record, and a sequential reader.

The reader goes through a file once: it inflates member by member with an incremental zlib object, bounded in what it is
fed and in what it gives, parses a record's headers, takes Content-Length bytes as its block and verifies the block's
digest. A member that holds several records gives a row for each. A file is one task's work (members can't be found
without reading), so parallelism is the number of files.

Defined cases of the reader: what can't be inflated, isn't a record, has headers of over ``HEAD`` bytes or a Content-Length
that is no number from 0 on gives a row with status ``corrupt``, and reading goes on at the next member; a file that ends
within a member, or a block shorter than its Content-Length, gives status ``truncated``. digest is ``ok``, ``bad``, or
``none`` where there is none or its algorithm is unknown. A very long block is inflated piece by piece and held once, as
its row has it whole. An empty file has no records. Of the writer: null url or html are marked and come back null; empty
ones come back empty; url may hold line breaks; repeated rows, and rows of equal or null id, are records of their own in
the order of their partition; further columns aren't archived and may have any names; no rows: no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import roles, scratch_path, written
from .files import listed, opened, replaced

BLOCK, PIECE, HEAD = 1 << 18, 1 << 18, 1 << 20
FILE_BYTES = 256 << 20
SCHEMA = "file string, offset bigint, warc_type string, record_id string, target_uri string, content_type string, content_length bigint, block binary, digest string, status string, headers map<string,string>"
_MAGIC = b"\x1f\x8b\x08"


def record(headers: dict[str, str], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(number, url: str | None, html: str | None) -> bytes:
    block = (html or "").encode("utf-8", "surrogatepass")
    headers = {"WARC-Type": "resource", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{number}|{url}')}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "text/html"}
    if url is not None:
        plain = url.isprintable() and url == url.strip()
        headers["WARC-Target-URI" if plain else "X-Target-Base64"] = url if plain else base64.b64encode(url.encode("utf-8", "surrogatepass")).decode()
    if number is not None:
        headers["X-Row"] = str(number)
    if html is None:
        headers["X-Null-Block"] = "1"
    headers["WARC-Block-Digest"] = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    return record(headers, block)


def digest_status(stated: str | None, block: bytes) -> str:
    name, _, value = (stated or "").partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5") or not value:
        return "none"
    own = hashlib.new(name, block).digest()
    return "ok" if value.upper().rstrip("=") in (base64.b32encode(own).decode().rstrip("="), own.hex().upper()) else "bad"


class _Source:
    """A stream's raw bytes in blocks, and the file offset of the next one."""

    def __init__(self, stream, block: int):
        self.stream, self.block, self.held, self.at, self.base, self.ended = stream, block, b"", 0, 0, False

    def more(self) -> bool:
        if not self.ended:
            new = self.stream.read(self.block)
            self.ended = not new
            self.held, self.at = self.held[self.at :] + new, 0
        return not self.ended

    def left(self) -> int:
        return len(self.held) - self.at

    def skip(self, n: int) -> None:
        self.at, self.base = self.at + n, self.base + n

    def starts(self, mark: bytes) -> bool:
        while self.left() < len(mark) and self.more():
            pass
        return self.held.startswith(mark, self.at)

    def find(self, mark: bytes) -> bool:
        """Goes on to the next mark."""
        while (to := self.held.find(mark, self.at)) < 0:
            self.skip(max(0, self.left() - len(mark) + 1))
            if not self.more():
                return False
        self.skip(to - self.at)
        return True


class _Member:
    """One gzip member's content, inflated as far as it is asked for."""

    def __init__(self, source: _Source):
        self.source, self.inflate, self.data, self.bad, self.full, self.step = source, zlib.decompressobj(31), bytearray(), False, False, 4096

    def more(self) -> bool:
        """A piece more; False at the end, whole or not."""
        source = self.source
        while not (self.inflate.eof or self.bad):
            if not source.left() and not self.full and not source.more():
                return False
            fed = source.held[source.at : source.at + self.step]
            try:
                out = self.inflate.decompress(fed, PIECE)
            except zlib.error:
                self.bad = True
                return False
            rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            source.skip(len(fed) - len(rest))
            self.full, self.step = len(out) == PIECE, min(self.step * 2, 1 << 16)
            if out:
                self.data += out
                return True
        return False

    def take(self, n: int) -> bytes:
        while len(self.data) < n and self.more():
            pass
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def line_ends(self) -> None:
        """Passes over line ends."""
        while True:
            n = len(self.data) - len(self.data.lstrip(b"\r\n"))
            del self.data[:n]
            if self.data or not self.more():
                return

    def head(self) -> bytes | None:
        """What stands before the next empty line; None if none comes."""
        seen = 0
        while (to := self.data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.data)
            if seen > HEAD or not self.more():
                return None
        return self.take(to + 4)[:-4]

    def drain(self) -> None:
        self.data.clear()
        while self.more():
            self.data.clear()


def _headers(head: bytes) -> dict[str, str]:
    headers: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:  # folded
            headers[last] += " " + line.strip()
            continue
        key, _, value = line.partition(":")
        last = key.strip().lower()
        headers[last] = value.strip()
    return headers


def _member_records(member: _Member) -> Iterator[dict]:
    """The rows of a member. The last may lack its end, or be something else than a record."""
    count = 0
    while True:
        member.line_ends()
        if not member.data and count and member.inflate.eof:
            return
        if not member.data and count:  # broken off between records: what came before was whole
            yield {"status": "corrupt" if member.bad else "truncated"}
            return
        count += 1
        head = member.head() if member.data else None
        if head is None or not head.startswith(b"WARC/"):
            cut = not member.bad and not member.inflate.eof and len(member.data) <= HEAD and head is None
            yield {"status": "truncated" if cut else "corrupt"}
            return
        headers = _headers(head)
        stated = headers.get("content-length", "")
        if not (stated.isascii() and stated.isdigit()):
            yield {"status": "corrupt", "headers": headers}
            return
        length = int(stated)
        block = member.take(length)
        if member.bad:
            yield {"status": "corrupt"}
            return
        row = {"warc_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"), "target_uri": headers.get("warc-target-uri"), "content_type": headers.get("content-type"), "content_length": length, "block": block, "headers": headers}
        if len(block) < length:
            yield row | {"status": "truncated", "digest": "none"}
            return
        member.line_ends()
        if not member.data and member.bad:
            yield {"status": "corrupt"}
            return
        whole = bool(member.data) or member.inflate.eof
        yield row | {"status": "ok" if whole else "truncated", "digest": digest_status(headers.get("warc-block-digest"), block)}
        if not member.data:
            return


def records(stream, block: int = BLOCK) -> Iterator[dict]:
    """The rows of a file, one after the other, with the offset at which each member begins."""
    source = _Source(stream, block)
    while True:
        whole = source.starts(_MAGIC)
        if not source.left():
            return
        begin = source.base
        if not whole:
            yield {"offset": begin, "status": "corrupt"}
            source.skip(1)
            if not source.find(_MAGIC):
                return
            continue
        member = _Member(source)
        for row in _member_records(member):
            yield {"offset": begin} | row
        member.drain()
        if member.bad:
            if source.base == begin:
                source.skip(1)
            if not source.find(_MAGIC):
                return


def write_pages(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives every row; returns (file, records, bytes). Each partition writes its own files, under names that its retries write again."""

    def run(batches):
        part = TaskContext.get().partitionId()
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3))))
        held = next(rows, None)
        number = 0
        while held is not None:
            size = count = 0

            def fill(out):
                nonlocal size, count, held
                while held is not None and (not count or size < file_bytes):
                    size += out.write(page_record(*held))
                    count += 1
                    held = next(rows, None)

            name = f"{folder}/part-{part:06d}-{number:04d}.warc.gz"
            replaced(name, fill)
            number += 1
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]})

    source = roles(pages, i=id_col, u=url_col, h=html_col).select("i", F.col("u").cast("string"), F.col("h").cast("string"))
    return written(source.mapInArrow(run, "file string, records bigint, bytes bigint"), "warc-files")


def read_warc(spark: SparkSession, files: DataFrame | str, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of all files: a folder's, or those named by the column ``file``."""
    if isinstance(files, str):
        folder = files.rstrip("/")
        files = spark.createDataFrame([(f"{folder}/{p}",) for p, _ in listed(folder, ".gz")], "file string")
    files = files.select("file")
    files = files.repartition(max(1, min(10_000, files.count())))  # a file is a task
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("block", pa.binary()), ("digest", pa.string()), ("status", pa.string()), ("headers", pa.map_(pa.string(), pa.string()))])

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                system, path = opened(name)
                held, size = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for row in records(stream):
                        held.append(row | {"file": name, "headers": list(row.get("headers", {}).items())})
                        size += len(row.get("block") or b"") + 500
                        if size > batch_bytes:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.mapInArrow(run, SCHEMA)


def pages_of(archive: DataFrame, id_type: str = "bigint") -> DataFrame:
    """page_id, url, html, content_length, digest, status, record_id and the block's SHA-1 of records that ``write_pages`` made."""
    head = F.col("headers")
    url = F.coalesce(F.col("target_uri"), F.unbase64(head["x-target-base64"]).cast("string"))
    html = F.when(head["x-null-block"].isNull(), F.col("block").cast("string"))
    return archive.select(head["x-row"].cast(id_type).alias("page_id"), url.alias("url"), html.alias("html"), "content_length", "digest", "status", "record_id", F.sha1("block").alias("block_sha1"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages archived into the shared folder and read back."""
    spark = pages.sparkSession
    return pages_of(read_warc(spark, write_pages(pages, scratch_path(spark, "warc"))))


def sql() -> str:
    """``round_trip`` over a table ``pages`` without nulls: lengths, digests and the records' name-based UUIDs worked out from the pages."""
    return """
WITH p AS (SELECT page_id, url, html, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(page_id || '|' || url)) AS h FROM pages)
SELECT page_id, url, html, CAST(strlen(html) AS BIGINT) AS content_length, 'ok' AS digest, 'ok' AS status,
  '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + ('0x' || h[17:17])::INTEGER % 4, 1) || h[18:20] || '-' || h[21:32] || '>' AS record_id, sha1(html) AS block_sha1
FROM p
"""
