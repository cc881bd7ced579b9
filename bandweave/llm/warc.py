"""WARC archives: a writer with one gzip member per record, and a sequential reader.

An archive is one row (archive, content) of at most about ARCHIVE_BYTES, or one record if that is larger. Kept as a
table, archives need no file system but Spark's; write_files() and read_files() exchange them with real .warc.gz files.
The reader takes one gzip member at a time, inflates it in steps, frames the record by its content-length, and verifies
the block digest and, for what is not a revisit, the payload digest, as far as they are given. Records of other writers
and of any type are read too.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave.llm.common import bounded_batches, materialize, unused

ARCHIVE_BYTES = 4 << 20
STEP = 64 << 10
GZIP_LEVEL = 4
#: Rows whose payload has at least this many bytes are revisits of an equal payload.
REVISIT_FROM = 0
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "record_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary, archive string, position long"
#: Digest algorithms that headers name, and the length of their digests in base32.
_ALGORITHMS = {"sha1": 32, "sha256": 56, "sha512": 104, "md5": 32}


class WarcError(ValueError):
    """A record that is cut short, wrongly framed, or whose digest does not match."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(text: str) -> str:
    """A header's value cannot hold line ends or NUL; they are percent-encoded (and stay so when read back)."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n\x00" else c for c in text)


def record_name(page_id) -> str:
    """The record id of a page, and so of what a revisit refers to."""
    return "<urn:no-page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(record_id: str | None) -> str | None:
    """The page's id as text; null for a page without id and for records of other writers."""
    found = re.fullmatch("<urn:page:(.*)>", record_id or "")
    return unquote(found[1]) if found else None


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record as a gzip member. A revisit's block has the HTTP headers only; their content-length is the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {_DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_one_line(url)}"]),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        *([] if refers_to is None else [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    plain = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(plain) + packer.flush()


def members(stream: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(position, inflated bytes) of each gzip member, read and inflated in steps: one record is held at a time."""
    held, at = b"", 0
    while held := held or stream.read(STEP):
        start, inflater, parts = at, zlib.decompressobj(31), []
        while not inflater.eof:
            if not held:
                raise WarcError(f"the member at byte {start} is cut short")
            try:
                parts.append(inflater.decompress(held))
            except zlib.error as broken:
                raise WarcError(f"the member at byte {start} is broken: {broken}") from broken
            at += len(held) - len(inflater.unused_data)
            held = inflater.unused_data if inflater.eof else stream.read(STEP)
        yield start, b"".join(parts)


def parse(plain: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names; a folded line goes on with the one before) and block of one record."""
    head, found, rest = plain.partition(b"\r\n\r\n")
    version, *lines = re.sub("\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    if not found or not version.startswith("WARC/"):
        raise WarcError("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = headers.get("content-length", "")
    if not size.isdecimal() or rest[int(size) :] != b"\r\n\r\n":
        raise WarcError("content-length does not frame the record")
    return headers, rest[: int(size)]


def _matches(said: str | None, data: bytes) -> bool:
    """Whether data has the digest that a header says, in base32 or hex; unknown algorithms and none match."""
    name, _, value = (said or "").partition(":")
    if name.lower() not in _ALGORITHMS or not value:
        return True
    own = hashlib.new(name.lower(), data).digest()
    return value.upper() in (base64.b32encode(own).decode(), base64.b32encode(own).decode().rstrip("="), own.hex().upper())


def read_stream(stream: BinaryIO) -> Iterator[tuple]:
    """The fields of RECORD_SCHEMA up to payload, and the position, of each record in turn.

    The payload is the block without its HTTP head, where it has one. payload_digest is without its algorithm's name, of
    the payload where the header has none. payload_bytes is what the HTTP head of a revisit says, else the payload's.
    """
    for position, plain in members(stream):
        headers, block = parse(plain)
        if not _matches(headers.get("warc-block-digest"), block):
            raise WarcError(f"block digest of the record at byte {position} does not match")
        head, payload, kind = b"", block, headers.get("warc-type", "")
        if headers.get("content-type", "").lower().startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
        length, said = fields.get(b"content-length", b""), headers.get("warc-payload-digest")
        size = int(length) if length.isdigit() and b"transfer-encoding" not in fields else None
        if kind != "revisit" and b"transfer-encoding" not in fields and "warc-truncated" not in headers:
            if not _matches(said, payload) or (kind == "response" and size not in (None, len(payload))):
                raise WarcError(f"payload digest of the record at byte {position} does not match")
        mark = said.partition(":")[2] if said else digest(payload)
        whole = size if kind == "revisit" and size is not None else len(payload)
        yield headers.get("warc-record-id"), headers.get("warc-target-uri"), kind, mark, whole, headers.get("warc-refers-to"), None if kind == "revisit" else payload, position


def read_archive(content: bytes) -> Iterator[tuple]:
    return read_stream(io.BytesIO(content))


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", at_least: int = REVISIT_FROM) -> DataFrame:
    """pages with refers_to: of equal payloads of at_least bytes or more, the smallest id for all other rows, else null.

    A column of pages named refers_to is replaced, others stay, whatever their names; ids are of any type with an order.
    A null payload counts as empty. Rows without an id never are what others refer to, unless no row of the group has
    one (then none is a revisit). Rows that repeat the smallest id itself stay responses.
    """
    key, low, count = unused(pages, "_key", "_first", "_n")
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.withColumn(key, F.when(F.length(payload) >= at_least, F.sha2(payload, 256)))
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias(low), F.count("*").alias(count))
    first = first.where((F.col(count) > 1) & F.col(low).isNotNull()).drop(count)
    # read from a table, so that the join's sides are plain exchanges and a very common payload's rows can be split
    joined = rows.join(materialize(first), key, "left")
    other = F.col(low).isNotNull() & ~F.col(low).eqNullSafe(F.col(id_col))
    return joined.withColumn("refers_to", F.when(other, F.col(low))).select(*[c for c in pages.columns if c.lower() != "refers_to"], "refers_to")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content) rows: a record for each row of pages, which needs the column refers_to."""
    bounded_batches(pages.sparkSession)
    names = [id_col, url_col, payload_col, "refers_to"]

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{made:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = record(page_id, url, (html or "").encode(), refers_to)
                if held and size + len(data) > archive_bytes:
                    yield out()
                    made, held, size = made + 1, [], 0
                held.append(data)
                size += len(data)
        if held:
            yield out()

    return pages.select(*names).mapInArrow(write, "archive string, content binary")


def _records(found: Iterator[tuple], archive: str, payloads: bool):
    """Arrow batches of one archive's records in RECORD_SCHEMA."""
    import pyarrow as pa

    text = pa.string()
    kinds = [text, text, text, text, pa.int64(), text, pa.binary(), text, pa.int64()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    rows, size = [], 0
    for *fields, payload, position in found:
        rows.append((*fields, payload if payloads else None, archive, position))
        size += len(payload or b"") * payloads + 200
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of (archive, content) rows in RECORD_SCHEMA; a broken archive fails. payloads=False leaves payload null."""

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _records(read_archive(batch.column(1)[i].as_py()), batch.column(0)[i].as_py(), payloads)

    bounded_batches(archives.sparkSession)
    return archives.select("archive", "content").mapInArrow(read, RECORD_SCHEMA)


def write_files(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file in a folder that all executors mount; returns (archive, bytes). A retry overwrites."""

    def write(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = os.path.join(folder, name)
                part = f"{whole}.{os.getpid()}"
                with open(part, "wb") as file:
                    file.write(content)
                os.replace(part, whole)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)])], names=["archive", "bytes"])

    return archives.mapInArrow(write, "archive string, bytes long")


def read_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records, in RECORD_SCHEMA, of the .warc.gz files at a path.

    Files of a folder that all executors mount (file:) are streamed, one record at a time, whatever their size. Files of
    other stores come through Spark's reader as a whole, and so can have at most spark.sql.sources.binaryFile.maxLength.
    """
    files = spark.read.format("binaryFile").load(path)
    mounted = F.col("path").startswith("file:")

    def read(batches):
        from urllib.parse import unquote, urlparse

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open(unquote(urlparse(name).path), "rb") as stream:
                    yield from _records(read_stream(stream), name, payloads)

    streamed = files.where(mounted).select("path").mapInArrow(read, RECORD_SCHEMA)
    if files.where(~mounted).select("path").isEmpty():
        return streamed
    return streamed.unionByName(read_archives(files.where(~mounted).select(F.col("path").alias("archive"), "content"), payloads))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = materialize(write_archives(with_revisits(pages)))
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("long")
    return read_archives(archives, payloads=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
), a AS (
  SELECT page_id, first_id, strlen(html)::BIGINT AS payload_bytes, unhex(sha1(html)) AS d FROM p
), b AS (
  SELECT *, list_transform(range(0, 32), lambda i: (
      (get_bit(d::BIT, (5 * i)::INT) * 16 + get_bit(d::BIT, (5 * i + 1)::INT) * 8 + get_bit(d::BIT, (5 * i + 2)::INT) * 4
       + get_bit(d::BIT, (5 * i + 3)::INT) * 2 + get_bit(d::BIT, (5 * i + 4)::INT)))) AS v FROM a
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""
