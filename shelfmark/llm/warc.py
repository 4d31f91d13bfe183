"""WARC archives: a writer with revisit records, and a sequential reader.

An archive has one gzip member per record. The reader takes chunks of bytes,
decompresses member by member with zlib as they come, frames each record by
its Content-Length, and verifies block and payload digests; what is truncated
or wrong raises WarcError.

Archives are written from Spark tasks to a folder that all executors share
(any URI that pyarrow.fs opens), at most about `archive_bytes` each. A task
reports the archives it has finished; only those of committed tasks get into
the list that is read back, so tasks may be lost and repeated.

A null html is an empty payload and a null url an empty one. Of equal payloads
the row of smallest page_id is the response (all rows of that id, if it is
repeated; without any id, every row) and the others revisit it. A hot payload
is one row on the right of the join, whose left side may be split.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import scratch, small_batches, table, written

CHUNK = 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes, level: int = 4) -> bytes:
    """A record as a gzip member. Line ends in header values become blanks."""
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in lines)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url or ""),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        return record(headers, HTTP + payload)
    return record([*headers, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")], HTTP)


class WarcReader:
    """Iterates over the (headers, block) of an archive given as chunks of bytes of any size. Header names are lower-cased."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.raw = iter(chunks), b""

    def more(self) -> bool:
        while not self.raw:
            chunk = next(self.chunks, None)
            if chunk is None:
                return False
            self.raw = bytes(chunk)
        return True

    def pieces(self) -> Iterator[bytes]:
        """The next member's content in pieces of at most CHUNK bytes."""
        z, full = zlib.decompressobj(31), False
        while not z.eof:
            if not full and not self.more():
                raise WarcError("the archive ends within a member")
            try:
                data = z.decompress(self.raw, CHUNK)
            except zlib.error as error:
                raise WarcError(f"not a gzip member: {error}") from error
            self.raw, full = (z.unused_data if z.eof else z.unconsumed_tail), len(data) == CHUNK
            if data:
                yield data

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while self.more():
            pieces, got = self.pieces(), bytearray()
            while (end := got.find(b"\r\n\r\n")) < 0:
                piece = next(pieces, None)
                if piece is None:
                    raise WarcError("a record without a full header")
                got += piece
            first, *lines = bytes(got[:end]).decode("utf-8", "surrogatepass").split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            if not first.startswith("WARC/") or not headers.get("content-length", "").isdigit():
                raise WarcError(f"not a WARC record: {first[:40]}")
            length = int(headers["content-length"])
            body = got[end + 4 :]
            for piece in pieces:
                body += piece
                if len(body) > length + 4:
                    break
            if bytes(body[length:]) != b"\r\n\r\n":
                raise WarcError("the block's length is not its Content-Length")
            block = bytes(body[:length])
            verify(headers, block)
            yield headers, block


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def verify(headers: dict[str, str], block: bytes) -> None:
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", payload_of(block))):
        if (said := headers.get(name)) and not (name == "warc-payload-digest" and headers.get("warc-type") == "revisit") and said != f"sha1:{digest(data)}":
            raise WarcError(f"{name} is wrong for {headers.get('warc-record-id')}")


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, archive_bytes: int = 16_000_000) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); the archives' list (path, records, bytes)."""
    small_batches(pages.sparkSession)
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"))
    rows = rows.withColumn("sha1", F.when(F.octet_length("payload") >= min_revisit_bytes, F.sha1("payload")))
    firsts = rows.filter("sha1 IS NOT NULL").groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha1", "first")
    joined = rows.join(firsts, "sha1", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        path, out, n, size = None, None, 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}], schema=listed)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                data = page_record(*row)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    listed = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    return written(joined.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record of the listed archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if wanted, payload."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def number(uri: str | None) -> int | None:
        tail = (uri or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for headers, block in WarcReader(iter(lambda s=stream: s.read(CHUNK), b"")):
                        payload, kind = payload_of(block), headers["warc-type"]
                        size = len(payload) if kind == "response" else int(headers["x-payload-length"])
                        rows.append((number(headers["warc-record-id"]), headers["warc-target-uri"], size, headers["warc-payload-digest"].removeprefix("sha1:"), kind, number(headers.get("warc-refers-to")), *([payload] if payloads else [])))
                        held += len(payload) * payloads + 200
                        if held > 4_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    spread = max(2 * archives.sparkSession.sparkContext.defaultParallelism, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("path").repartition(spread, "path").mapInArrow(run, schema)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(archives, folder).drop("url")
