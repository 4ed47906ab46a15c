"""WARC archives as chunked record tables.

Writing: pages are grouped by payload digest on light rows only (no payload is shuffled for it); of
equal payloads the one of the largest page id becomes the response, the others revisit it. Payloads
reach the writers as chunk rows of at most ``CHUNK`` bytes, so a Python worker never holds a whole
large record. Each task streams its records into files in the shared folder (each record a gzip member,
as is usual), under a temporary name until they are complete; a retried task writes files of its own,
and only files of the finished attempt are in the manifest.

Reading: each file is streamed once into rows ``(record_id, chunk_no, ...)`` of at most ``CHUNK`` payload
bytes, each with the SHA-1 of the payload up to its end (``digest``), so the last row of a record
carries the whole payload's digest and length without anyone having held it.

Defined results: a null html is an empty payload, which equal payloads of 0 bytes share. Payloads
below ``min_bytes`` are all responses. A null page id is smaller than any other; of equal ids the
larger url wins, and repeated rows give one response and revisits of it. A null url is written as an
empty one, a long one in whole. An empty table gives an empty table. Extra columns are ignored. A file that is not a WARC
archive, or is cut short, raises ``ValueError``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, join_spread, saved, scratch_path, shuffle_partitions

CHUNK = 256 << 10
ROLL = 1 << 30
LEVEL = 3
MOST_HEADER = 1 << 30  # an url is as long as a row may hold; a longer header is damage
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
CHUNKS = "record_id string, record_type string, page_id long, url string, refers_to string, chunk_no long, start long, length long, digest string, last boolean"


def payload(html: Column) -> Column:
    return F.coalesce(F.encode(html, "UTF-8"), F.lit(b""))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of each record to write, a record's chunks in order beside each other."""
    data = payload(F.col("html"))
    keyed = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.sha1(data).alias("sha1"), F.length(data).cast("long").alias("size"), data.alias("payload"))
    keyed = keyed.withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    light = keyed.groupBy("sha1", "size", "page", "page_id", "url").agg(F.count("*").alias("copies"))
    best = light.filter(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count("*").alias("n"))
    best = saved(best, "warc-best")
    is_best = F.col("page_id").eqNullSafe(F.col("best.page_id")) & (F.col("url") == F.col("best.url"))
    # responses: the only rows that carry payload, one for each digest, so no digest is heavy
    small = keyed.filter(F.col("size") < min_bytes)
    keys = ["sha1", "size", "page", "url"]  # plain and without nulls: the join's shuffle serves the next step too
    winner = best.select("sha1", "size", F.coalesce(F.col("best.page_id").cast("string"), F.lit("")).alias("page"), "best.url")
    first = keyed.join(winner, keys, "left_semi").dropDuplicates(keys)
    full = first.unionByName(small) if min_bytes > 0 else first
    n = F.greatest(F.ceil(F.col("size") / chunk), F.lit(1)).cast("int")
    full = full.withColumn("at", F.explode(F.sequence(F.lit(0), n - 1))).select(
        _urn(F.lit("response"), F.col("sha1"), F.col("page_id"), F.col("url")).alias("record_id"), F.lit("response").alias("record_type"), "page_id", "url",
        F.lit(None).cast("string").alias("refers_to"), "sha1", "size", (F.col("at") == n - 1).alias("last"), F.substring("payload", F.col("at") * chunk + 1, F.lit(chunk)).alias("chunk"),
    )
    again = join_spread(light, best, ["sha1", "size"], "n", best.agg(F.sum("n")).first()[0] or 0)
    again = again.withColumn("times", F.col("copies") - F.when(is_best, 1).otherwise(0)).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    again = again.select(
        _urn(F.lit("revisit"), F.col("sha1"), F.col("page_id"), F.col("url"), F.col("copy")).alias("record_id"), F.lit("revisit").alias("record_type"), "page_id", "url",
        _urn(F.lit("response"), F.col("sha1"), F.col("best.page_id"), F.col("best.url")).alias("refers_to"), "sha1", F.lit(0).cast("long").alias("size"), F.lit(True).alias("last"), F.lit(b"").alias("chunk"),
    )
    return full.unionByName(again)


def bare_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _head(r: dict) -> bytes:
    """The record's header and the HTTP header that opens its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['size']}\r\n\r\n" if r["record_type"] == "response" else "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = [
        "WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + r["url"].replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{bare_digest(bytes.fromhex(r['sha1']))}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + r['size']}",
    ]
    if r["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {r['refers_to']}"]
    if r["page_id"] is not None:
        lines.append(f"X-Page-Id: {r['page_id']}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


class _Archive:
    """One archive being written, each record a gzip member of its own; it gets its name when it is whole."""

    def __init__(self, files: pafs.FileSystem, folder: str):
        self.files, self.name = files, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        self.out = files.open_output_stream(f"{self.name}.part", buffer_size=1 << 20, compression=None)
        self.records = self.size = 0
        self.member = None

    def write(self, data: bytes) -> None:
        if self.member is None:
            self.member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self._put(self.member.compress(data))

    def end_record(self) -> None:
        self.write(b"\r\n\r\n")
        self._put(self.member.flush())
        self.member, self.records = None, self.records + 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.files.move(f"{self.name}.part", self.name)
        return self.name, self.records, self.size


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        archive, done, first = None, [], True
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                archive = archive or _Archive(files, base)
                if first:
                    archive.write(_head(r))
                archive.write(r["chunk"])
                first = r["last"]
                if first:
                    archive.end_record()
                    if archive.size >= ROLL:
                        done.append(archive.close())
                        archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "bytes"])

    return run


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared place, as a URI that pyarrow opens too."""
    path = scratch_path(spark, "warc")
    fs, p = filesystem(spark, path)
    fs.mkdirs(p)
    uri = fs.makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def write_archives(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes (page_id, url, html) rows; the folder's URI and the manifest (path, records, bytes)."""
    folder = folder or _folder(pages.sparkSession)
    return folder, saved(records(pages, min_bytes, chunk).mapInArrow(_write(folder), MANIFEST), "warc-manifest")


def _header(f: io.BufferedReader, start: bytes | None = None) -> dict[str, str]:
    """Header lines up to the blank one, names in lower case; empty at the end of the file."""
    out: dict[str, str] = {}
    total = 0
    first = True
    while True:
        line = f.readline(MOST_HEADER)
        total += len(line)
        if first and not line:
            return out
        if not line.endswith(b"\n") or total > MOST_HEADER:
            raise ValueError("a header is cut short or too long")
        if first:
            if start and not line.startswith(start):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            first, out[""] = False, str(total)
            continue
        if line == b"\r\n":
            out["#"] = str(total)
            return out
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()


def stream_records(f, chunk: int = CHUNK, data: bool = False) -> Iterator[tuple]:
    """Rows of ``CHUNKS`` (and the bytes, where ``data``) of an open archive, in order."""
    f = io.BufferedReader(f, 1 << 20)
    while True:
        h = _header(f, b"WARC/")
        if not h:
            return
        left = int(h["content-length"])
        if h.get("content-type", "").startswith("application/http") and left:
            left -= int(_header(f)["#"])
        if left < 0:
            raise ValueError("a record's block is shorter than its header")
        page = int(h["x-page-id"]) if "x-page-id" in h else None
        digest, at, no = hashlib.sha1(), 0, 0
        while True:
            piece = f.read(min(chunk, left))
            if left and not piece:
                raise ValueError("a record is cut short")
            left -= len(piece)
            digest.update(piece)
            row = (h["warc-record-id"], h["warc-type"], page, h.get("warc-target-uri", ""), h.get("warc-refers-to"), no, at, len(piece), bare_digest(digest.copy().digest()), not left)
            yield (*row, piece) if data else row
            at, no = at + len(piece), no + 1
            if not left:
                break
        if f.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end in two line ends")


def _read(folder: str, chunk: int, data: bool):
    names = [c.split()[0] for c in CHUNKS.split(", ")] + ["data"] * data
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * data

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as raw:
                    f = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                    rows: list[tuple] = []
                    held = 0
                    for row in stream_records(f, chunk, data):
                        rows.append(row)
                        held += row[7]
                        if len(rows) >= 10_000 or data and held >= 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return run


def read_archives(folder: str, manifest: DataFrame, chunk: int = CHUNK, data: bool = False) -> DataFrame:
    """The chunked record table of the manifest's files; one task streams a file."""
    n = shuffle_partitions(manifest.sparkSession)
    return manifest.select("path").repartition(n).mapInArrow(_read(folder, chunk, data), CHUNKS + ", data binary" * data)


def summary(chunks: DataFrame) -> DataFrame:
    """Per record: (page_id, payload_bytes, payload_digest, record_type, refers_to), revisits resolved."""
    whole = chunks.filter("last").select("record_id", "record_type", "page_id", "refers_to", (F.col("start") + F.col("length")).alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    response = whole.filter("record_type = 'response'")
    found = response.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisit = whole.filter("record_type = 'revisit'").alias("v").join(response.alias("r"), F.col("v.refers_to") == F.col("r.record_id"), "left")
    return found.unionByName(revisit.select("v.page_id", "r.payload_bytes", "r.payload_digest", "v.record_type", F.col("r.page_id").alias("refers_to")))


def round_trip(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    folder, manifest = write_archives(pages, min_bytes, chunk)
    return summary(saved(read_archives(folder, manifest, chunk), "warc-chunks"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
best AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM p JOIN best USING (h)
"""
