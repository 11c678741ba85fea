"""WARC archives: a writer with one gzip member per record, and a sequential reader.

Writing: every task writes the records of its rows, one after the other, to archives of its own in the shared folder (any file
system that pyarrow reaches), and returns their paths; only the paths of tasks that ended well get into the manifest, which is
itself a durable table, so a repeated task leaves at most a file that nobody reads.

Reading: archives are dealt over tasks; each is read as a stream of small blocks, inflated member by member, and framed by
Content-Length, never whole. Digests are checked while the bytes pass.

Equal payloads of at least ``least`` bytes are stored once: the row with the largest id is a response, the others are revisits
of it (profile identical-payload-digest), which carry the HTTP head alone.

Defined results: a null payload is empty; a null id is kept as null, and never referred to unless all ids of a payload are null, in which case all
its rows are responses; rows that share the largest id of a payload are all responses; a null URL leaves its header out; a table without rows
makes no archives and gives no rows. A truncated record, a wrong length or a wrong digest raises an error with the archive's
path and the record's id.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.core import durable, lean, lookup, work_path

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 1 << 30
_READ = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record, uncompressed; refers_to makes it a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: {_digest(hashlib.sha1(block).digest())}", f"WARC-Payload-Digest: {_digest(hashlib.sha1(payload).digest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Member:
    """The inflated bytes of one gzip member, a block at a time; what follows the member in the file goes back to ``rest``."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.rest, self.z, self.buffer = stream, rest, zlib.decompressobj(31), b""

    def more(self) -> bool:
        while not self.z.eof:
            raw = self.z.unconsumed_tail or self.rest or self.stream.read(_READ)
            self.rest = b""
            if not raw:
                raise EOFError("the archive ends within a record")
            got = self.z.decompress(raw, _READ)
            if self.z.eof:
                self.rest = self.z.unused_data
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while mark not in self.buffer:
            if len(self.buffer) > most or not self.more():
                raise ValueError("a record's header has no end")
        out, _, self.buffer = self.buffer.partition(mark)
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            yield part


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def read_records(stream, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive in order, verified; with ``payloads`` also a response's payload."""
    rest = b""
    while rest or (rest := stream.read(_READ)):
        m = _Member(stream, rest)
        version, head = _fields(m.until(b"\r\n\r\n"))
        name = head.get("warc-record-id", "?")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        n, all_, own, keep = int(head["content-length"]), hashlib.sha1(), hashlib.sha1(), []
        http, seen = None, b""
        for part in m.take(n):
            all_.update(part)
            if http is None:
                seen += part
                if b"\r\n\r\n" not in seen:
                    continue
                top, _, part = seen.partition(b"\r\n\r\n")
                http = _fields(top)[1]
            own.update(part)
            if payloads:
                keep.append(part)
        while m.more():
            pass
        if m.buffer != b"\r\n\r\n":
            raise ValueError(f"{name}: the record doesn't end after Content-Length bytes")
        rest = m.rest
        if http is None:
            raise ValueError(f"{name}: no HTTP head")
        if _digest(all_.digest()) != head["warc-block-digest"]:
            raise ValueError(f"{name}: wrong block digest")
        kind = head["warc-type"]
        if kind == "response" and _digest(own.digest()) != head["warc-payload-digest"]:
            raise ValueError(f"{name}: wrong payload digest")
        out = {
            "page_id": _page(name),
            "url": head.get("warc-target-uri"),
            "record_type": kind,
            "refers_to": _page(head["warc-refers-to"]) if kind == "revisit" else None,
            "payload_bytes": int(http["content-length"]),
            "payload_digest": base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(),
        }
        yield out | ({"payload": b"".join(keep) if kind == "response" else None} if payloads else {})


def with_references(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the id of the response that a row revisits, null for responses."""
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    digest = F.when(F.octet_length("payload") >= least, F.concat_ws(":", F.sha1("payload"), F.octet_length("payload").cast("string")))
    # the count and maximum per digest are merged in each task before the shuffle, and the payloads stay behind
    again = durable(rows.select(digest.alias("d"), "page_id").filter("d is not null").groupBy("d").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1 and last is not null"))
    total = again.agg(F.sum("n")).first()[0] or 0
    found = lookup(rows.withColumn("d", digest), again, "d", "n", total)
    return found.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))).drop("d", "last")


def write_archives(rows: DataFrame, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes (page_id, url, payload, refers_to) as archives; gives the manifest (path, records, bytes), a durable table."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(work_path(spark))
    where = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///", 1)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(where)
        out, path, records, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": pa.array([path]), "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, refers = (batch.column(k)[i].as_py() for k in range(4))
                if out is None:
                    store.create_dir(base, recursive=True)
                    path, records, size = f"{base}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                data = member(record(page, url, payload, refers))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= most:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    written = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records bigint, bytes bigint")
    return durable(written.withColumn("store", F.lit(where)))


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives of a manifest, with the columns of RECORD."""
    n = max(1, manifest.count())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, _ = fs.FileSystem.from_uri(where)
                with store.open_input_stream(path, compression=None) as stream:
                    rows: list[dict] = []
                    try:
                        for r in read_records(stream):
                            rows.append(r)
                            if len(rows) == 4096:
                                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                                rows = []
                    except (ValueError, EOFError, zlib.error) as e:
                        raise ValueError(f"{os.path.basename(path)}: {e}") from e
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return manifest.select("store", "path").repartition(n).mapInArrow(run, RECORD)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = read_archives(write_archives(with_references(pages)))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> last THEN last END AS refers_to
FROM r
"""
