"""WARC archives: writing, normalising monolithic gzip, and reading by a sidecar offset index.

Crawl tools often compress a whole WARC file as one gzip stream, which no reader can enter midway. The
normaliser inflates such a stream once, front to back, holding one record at a time, rewrites every record as
a gzip member of its own, and writes beside it an index of offsets (``.idx``: offset, length, record id). Readers then
take stretches of an archive in parallel.

Files are written under a temporary name and renamed, and hold the same bytes when a task runs again.

Defined cases. Null html: an empty payload. Null url: the record's own id as target. Null page id: no id in
the record, null when read; such a page is a response unless an equal payload has an id. Rows that repeat the smallest
page_id of a payload are all responses. Empty tables: no archives, no rows. Further columns are ignored. A very long payload
is one record, of which a task holds two or three copies.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import maybe_broadcast, scratch, table, written

#: Payloads shorter than this many bytes are never revisits.
REVISIT_BYTES = 100
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest and refers_to: the smallest page_id of an equal payload, null for responses.

    Only digests that several pages share are joined.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("html")).withColumn("digest", F.sha2("html", 256))
    large = base.where(F.octet_length("html") >= REVISIT_BYTES)
    shared = written(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"), "digests")
    joined = base.join(maybe_broadcast(shared, shared.count(), 500_000), "digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))).drop("first")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the payload's length in its HTTP head, and not the payload."""
    own = f"urn:page:{page_id}" if page_id is not None else "urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, digest))
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else own
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Records of inflated WARC bytes, one at a time."""
    held, need, looked = bytearray(), 0, 0
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", max(at, looked - 3))
                if end < 0:
                    looked = len(held)
                    break
                need = end + 4 - at + int(headers(bytes(held[at:end]))["content-length"]) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need, looked = at + need, 0, 0
        if at:
            del held[:at]
            looked = max(0, looked - at)
    if held.strip():
        raise ValueError("the archive ends within a record")


def inflated(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file's bytes; its members, one or many, follow each other."""
    z = zlib.decompressobj(31)
    while chunk := stream.read(size):
        while chunk:
            if z.eof:
                z = zlib.decompressobj(31)
            out = z.decompress(chunk)
            chunk = z.unused_data
            if out:
                yield out
    if not z.eof:
        raise ValueError("the gzip stream is cut off")


class _Sink:
    """A file that appears under its name when complete."""

    def __init__(self, uri: str):
        self.files, self.path = fs.FileSystem.from_uri(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream, self.at = self.files.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.stream.close()
        self.files.move(self.own, self.path)


def _gathered(manifest: DataFrame) -> DataFrame:
    """A manifest whose files are written once: its rows, one an archive, are held by the driver."""
    return manifest.sparkSession.createDataFrame(manifest.collect(), MANIFEST)


def write_monolithic(pages: DataFrame, path: str, roll_mb: int = 256, level: int = 1) -> DataFrame:
    """Writes rows of ``with_revisits`` as WARC files, each one gzip stream, and returns their manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, sink, n, raw = TaskContext.get().partitionId(), 0, None, 0, 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                for row in b.slice(i, 256).to_pylist():
                    if sink is None:
                        sink, z, n, raw = _Sink(f"{path}/part-{part:06d}-{k:04d}.warc.gz"), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                    data = record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"])
                    n, raw = n + 1, raw + len(data)
                    sink.write(z.compress(data))
                    if raw > roll_mb << 20:
                        sink.write(z.flush())
                        sink.close()
                        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/part-{part:06d}-{k:04d}.warc.gz"]), pa.array([n]), pa.array([sink.at])], ["path", "records", "bytes"])
                        sink, k = None, k + 1
        if sink is not None:
            sink.write(z.flush())
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/part-{part:06d}-{k:04d}.warc.gz"]), pa.array([n]), pa.array([sink.at])], ["path", "records", "bytes"])

    return _gathered(pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, MANIFEST))


def normalise(manifest: DataFrame, path: str, level: int = 6) -> DataFrame:
    """Rewrites every archive with a member for each record and a sidecar index; returns the new manifest."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                files, old = fs.FileSystem.from_uri(uri)
                new = f"{path}/{uri.rpartition('/')[2]}"
                out, index, n = _Sink(new), _Sink(new + ".idx"), 0
                with files.open_input_stream(old, compression=None) as stream:
                    for raw in records_of(inflated(stream)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        own = headers(raw[: raw.index(b"\r\n\r\n")])["warc-record-id"]
                        index.write(f"{out.at}\t{len(member)}\t{own}\n".encode())
                        out.write(member)
                        n += 1
                index.close()
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([n]), pa.array([out.at])], ["path", "records", "bytes"])

    return _gathered(manifest.repartition(max(1, manifest.count())).mapInArrow(rewrite, MANIFEST))


def parsed(raw: bytes) -> tuple:
    """A record as a row of ``READ``; a payload that contradicts its digest is an error."""
    end = raw.index(b"\r\n\r\n")
    h = headers(raw[:end])
    block = raw[end + 4 : end + 4 + int(h["content-length"])]
    split = block.index(b"\r\n\r\n")
    payload, digest = block[split + 4 :], h["warc-payload-digest"].partition(":")[2]
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    revisit = h["warc-type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {h['warc-record-id']} doesn't match its digest")
    size = int(headers(block[:split])["content-length"])
    return number(h["warc-record-id"]), h["warc-target-uri"], None if revisit else payload, size, digest, h["warc-type"], number(h.get("warc-refers-to"))


def read_archives(manifest: DataFrame, stretch: int = 2000) -> DataFrame:
    """Records of normalised archives, ``stretch`` records to a task row, each found through the index."""
    spans = manifest.where("records > 0").select("path", F.explode(F.sequence(F.lit(0), F.col("records") - 1, F.lit(stretch))).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for span in b.to_pylist():
                files, path = fs.FileSystem.from_uri(span["path"])
                with files.open_input_stream(path + ".idx", compression=None) as x:
                    index = [tuple(map(int, r.split(b"\t")[:2])) for r in x.read().splitlines()[span["first"] : span["first"] + stretch]]
                with files.open_input_file(path) as x:
                    for at in range(0, len(index), 250):
                        rows = [parsed(zlib.decompress(x.read_at(n, where), 31)) for where, n in index[at : at + 250]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    tasks = max(1, spans.count())
    return spans.repartition(tasks).mapInArrow(read, READ)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    crawl = write_monolithic(with_revisits(table(spark, sf_dir, "pages")), f"{path}/crawl")
    return read_archives(normalise(crawl, f"{path}/archive")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
