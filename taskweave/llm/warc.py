"""WARC archives: written as one gzip member for each record, and read back as a stream.

Payloads are grouped by digest and length. In a group of equal payloads of ``LEAST`` bytes or more the largest page id is a response,
and the others revisit it; every smaller payload is a response. Writers roll their archives at ``ARCHIVE_BYTES``. The reader
decompresses archives piece by piece, frames records by their content length, and holds blocks and payloads against their digests; a cut
archive, or one with another number of records than were written, is an error. It
never has more than a piece of an archive in memory, and ``records`` gives payloads where they are wanted.

An empty table gives no archives and no rows. Payloads of any length are written from and read into pieces of bounded size, but for the row
that the table holds them in. Other columns are not looked at. A null html is an empty payload. A null url is written as an empty one. Rows that repeat the largest id of a group are all responses.
A null id never is a group's response unless all are null. Archives are complete files under names of their own; a lost task's
unfinished ones are never listed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskweave.llm.words import slices
from taskweave.shared import new_path, partitions, written

LEAST = 0
ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 16
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system that all executors share, by the scheme of the shared folder."""
    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _name(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record's bytes, uncompressed."""
    digest = _base32(hashlib.sha1(payload).digest())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        *([f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str):
    def run(batches):
        files, place = _open(folder)
        files.create_dir(place, recursive=True)
        out, name, size, n = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in slices(batches, "html", 1 << 20):
            for page, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, n = f"{place.rstrip('/')}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(name, compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(page, url, (html or "").encode(), refers_to, revisit)) + packer.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{a.rsplit('/', 1)[-1]}" for a, _ in done], pa.string()), pa.array([b for _, b in done], pa.int64())], names=["archive", "records"])

    return run


class _Stream:
    """The uncompressed bytes of a file of gzip members; a file that ends inside a member, its trailer included, is an error."""

    def __init__(self, source):
        self.source, self.packed, self.plain = source, b"", b""
        self.unpacker = None

    def _more(self) -> bool:
        """Unpacks another piece; False after the last member."""
        if not self.packed:
            self.packed = self.source.read(PIECE)
        if not self.packed:
            if self.unpacker is not None:
                raise ValueError("an archive ends inside a member")
            return False
        if self.unpacker is None:
            self.unpacker = zlib.decompressobj(31)
        self.plain += self.unpacker.decompress(self.packed, PIECE)
        if self.unpacker.eof:
            self.packed, self.unpacker = self.unpacker.unused_data, None
        else:
            self.packed = self.unpacker.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to a mark and past it; None at the end."""
        while (at := self.plain.find(mark)) < 0:
            if not self._more():
                if self.plain:
                    raise ValueError("an archive ends inside a record")
                return None
        found, self.plain = self.plain[:at], self.plain[at + len(mark) :]
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, piece by piece."""
        while n:
            if not self.plain and not self._more():
                raise ValueError("an archive ends inside a record")
            piece, self.plain = self.plain[:n], self.plain[n:]
            n -= len(piece)
            if piece:
                yield piece


def records(source, payloads: bool = False) -> Iterator[dict]:
    """The records of an open archive, in their order; a wrong digest or frame is an error."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        block_digest, payload_digest, inner, length, kept = hashlib.sha1(), hashlib.sha1(), b"", 0, []
        body = False
        for piece in stream.pieces(int(fields["Content-Length"])):
            block_digest.update(piece)
            if not body:
                inner += piece
                if (at := inner.find(b"\r\n\r\n")) < 0:
                    continue
                inner, piece, body = inner[:at], inner[at + 4 :], True
            payload_digest.update(piece)
            length += len(piece)
            if payloads:
                kept.append(piece)
        if b"".join(stream.pieces(4)) != b"\r\n\r\n":
            raise ValueError("a record is longer than its content length")
        wanted = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Block-Digest"] != "sha1:" + _base32(block_digest.digest()):
            raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
        revisit = fields["WARC-Type"] == "revisit"
        if not revisit and wanted != _base32(payload_digest.digest()):
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
        http = dict(line.split(": ", 1) for line in inner.decode().split("\r\n")[1:])
        yield {"type": fields["WARC-Type"], "page": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "bytes": int(http["Content-Length"]) if revisit else length, "digest": wanted, "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None, "payload": b"".join(kept) if payloads and not revisit else None}


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


def _read(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for archive, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            files, place = _open(archive)
            rows: list[dict] = []
            n = 0
            with files.open_input_stream(place, compression=None) as source:
                for n, r in enumerate(records(source), 1):  # noqa: B007
                    rows.append({"page_id": r["page"], "payload_bytes": r["bytes"], "payload_digest": r["digest"], "record_type": r["type"], "refers_to": r["refers_to"]})
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
            if expected is not None and n != expected:
                raise ValueError(f"{archive} has {n} records of {expected}")
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes all pages below ``folder``, which all executors share: (archive, records) of each archive."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).alias("size"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    salted = groups.select("digest", "size", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.join(salted, ["digest", "size", "salt"], "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.lit(False))
    ready = joined.select("page", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return written(ready.mapInArrow(_write(folder), "archive string, records long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """The records of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    An archive with another number of records than the column ``records`` says, where there is one, is an error.
    """
    n = partitions(archives.sparkSession)
    expected = F.col("records") if "records" in archives.columns else F.lit(None).cast("long")
    return archives.select("archive", expected.alias("records")).repartition(n).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8(spark, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc")))


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (i // 4)::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest FROM p
), g AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS first FROM d GROUP BY ALL
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN g USING (payload_digest, payload_bytes)
"""
