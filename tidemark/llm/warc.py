"""WARC: record-compressed archives written by tasks, and a splittable reader.

The reader deals out byte ranges of the files.  A task looks for gzip magic in its range, takes
a place as a member only if it inflates to a WARC header and, to its end, to a whole record with
a right checksum, and owns the records that start inside its range, wherever they end.  Files are
opened through pyarrow's file systems, by the address of the shared folder.  Every attempt of a
task writes files of its own; only those named in the stored manifest are read, so lost executors
and repeated attempts leave nothing behind in the result.
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

from .common import lean, new_path, resolve_groups, small_batches, stored

MAGIC = b"\x1f\x8b\x08"
#: Bytes of one range of the reader, and of one file of the writer, about.
RANGE_BYTES, FILE_BYTES = 8 << 20, 1 << 30
#: Bytes read at once.
CHUNK = 1 << 20
#: Revisits that are broadcast to the writer at most; more are joined by a shuffle.
REVISITS = 100_000
# The format's profile for equal payloads, and the prefix of record ids.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:tidemark:page:"
DATE = "2024-01-01T00:00:00Z"


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(url: str | None) -> str:
    """url as a header may hold it."""
    from urllib.parse import quote

    return quote(url or "", safe="%:/?#[]@!$&'()*+,;=~-._")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of refers_to without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of (page_id, url, html, refers_to); returns the stored manifest (path, bytes)."""

    @lean
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        fs.create_dir(base, recursive=True)
        out, size, number, done = None, 0, 0, []
        part = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page_id, url, html, refers = (c[i].as_py() for c in columns)
                if out is None:
                    name = f"{part}-{number}.warc.gz"
                    out, size, number = fs.open_output_stream(f"{base}/{name}", compression=None), 0, number + 1
                out.write(data := member(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers)))
                size += len(data)
                if size >= file_bytes:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{n}" for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], ["path", "bytes"])

    return stored(pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, bytes long"), "warc-manifest")


class Window:
    """Bytes of a file from a place on, read in chunks; those before the place in use are let go."""

    def __init__(self, source: pa.NativeFile, at: int, size: int, limit: int = CHUNK) -> None:
        self.source, self.base, self.data, self.size, self.limit = source, at, b"", size, limit
        source.seek(at)

    def more(self) -> bool:
        got = self.source.read(self.limit)
        self.data += got
        return bool(got)

    def forget(self, at: int) -> None:
        if at - self.base > 4 * CHUNK:
            self.data, self.base = self.data[at - self.base :], at


def inflate(window: Window, at: int) -> tuple[bytes, int] | None:
    """The record of the member at a place, and where the member ends; None if there is no whole record."""
    z, out, place = zlib.decompressobj(31), bytearray(), at - window.base
    try:
        while not z.eof:
            if place >= len(window.data) and not window.more():
                return None
            piece = window.data[place : place + 65536]
            out += z.decompress(piece)
            place += len(piece)
            if len(out) >= 7 and not out.startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    return bytes(out), window.base + place - len(z.unused_data)


def parsed(data: bytes) -> dict | None:
    """Headers in lower case, with the block at ''; None unless lengths are right."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        return None
    out: dict = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            return None
        out[key.strip().lower()] = value.strip()
    if not (n := out.get("content-length", "")).isdigit() or len(rest) != int(n) + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    return out | {"": rest[:-4]}


def records_of(source: pa.NativeFile, start: int, end: int, size: int) -> Iterator[dict]:
    """Records whose members start from start on and before end."""
    window, at = Window(source, start, size), start
    while at < end:
        place = window.data.find(MAGIC, at - window.base)
        if place < 0:
            at = max(at, window.base + len(window.data) - len(MAGIC) + 1)
            window.forget(at)
            if not window.more():
                return
            continue
        at = window.base + place
        if at >= end:
            return
        found = inflate(window, at)
        if found and (headers := parsed(found[0])):
            yield headers
            at = found[1]
        else:
            at += 1
        window.forget(at)


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of every record.

    payload is null for revisits.  Digest and size of a response are those of the bytes read; of a
    revisit those that its headers give, null where they don't.  Records of archives from
    elsewhere come too, of whatever type, the whole block as payload where it is no response;
    page_id is null where the record's id isn't one of write_archives.
    """
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, min(ranges.count(), 100_000)), "path", "start")

    def number(urn: str) -> int | None:
        tail = urn.strip("<>").removeprefix(URN)
        return int(tail) if tail.lstrip("-").isdigit() else None

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for r in batch.to_pylist():
                fs, path = file_system(r["path"])
                rows, held = [], 0
                with fs.open_input_file(path) as source:
                    for h in records_of(source, r["start"], min(r["start"] + range_bytes, r["bytes"]), r["bytes"]):
                        kind = h.get("warc-type", "")
                        http, _, payload = h[""].partition(b"\r\n\r\n") if kind in ("response", "revisit") else (b"", b"", h[""])
                        revisit = kind == "revisit"
                        if revisit:
                            sizes = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                            n = int(sizes[0]) if sizes and sizes[0].isdigit() else None
                            digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        else:
                            n, digest = len(payload), digest_of(payload)
                        rows.append((number(h.get("warc-record-id", "")), h.get("warc-target-uri"), n, digest, kind or None, number(h.get("warc-refers-to", "")) if revisit else None, None if revisit else payload))
                        held += len(payload)
                        if held > 8 * CHUNK or len(rows) >= 1024:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return ranges.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per page to a new folder in the shared one; returns the stored manifest.

    Of equal payloads of min_bytes or more the page with the largest id is the response and the
    others revisit it; rows repeated with the same id and payload are both responses.  A null
    payload counts as empty, a null url as empty; rows with null ids are responses unless a page
    with an id has their payload.  An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{payload_col}`").alias("html")).withColumn("digest", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))))
    digests = stored(rows.select("page_id", "digest", F.octet_length(F.coalesce("html", F.lit(""))).alias("size")), "payloads")
    settled = resolve_groups(digests, "digest", "page_id").where(F.col("size") >= min_bytes)
    revisits = stored(settled.where(~F.col("page_id").eqNullSafe(F.col("winner"))).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("winner").alias("refers_to")).distinct(), "revisits")
    side = F.broadcast(revisits) if revisits.count() <= REVISITS else revisits
    marked = rows.join(side, rows.page_id.eqNullSafe(side.r_id) & (rows.digest == side.r_digest), "left")
    return write_archives(marked, new_path(spark, "warc"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
     w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 10 * (i // 8) AS INT), 10) AS UBIGINT) >> CAST(35 - 5 * (i % 8) AS UBIGINT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM w
"""
