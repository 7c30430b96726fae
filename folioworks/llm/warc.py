"""WARC archives and their chunked record table.

Writing: records stream into gzip members of archive files in the shared folder, the payload in slices, so a record is
never copied whole. Of records with equal payloads the first is a response, the others are revisits that carry the
payload's digest and refer to the first.

Reading: an archive is inflated piece by piece and becomes rows of (record, chunk number): each chunk row has a slice of
the payload and the SHA-256 of the payload so far, and the last chunk row of a record has the whole payload's digest and
length. No record is held whole.

Defined results: a null html is an empty payload; payloads below DEDUP_BYTES are never revisits; null page_ids come
after all others when the first of equal payloads is sought, and rows that share the first page_id are all responses;
repeated rows are records of their own; null urls are written as an empty target; an empty table gives no archives and
no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm.common import hold, open_fs, read_table, shared_dir, tune

DEDUP_BYTES = 100
#: Payload bytes of a chunk row, and of what is read or written at once.
CHUNK = 1 << 20
#: Compressed bytes after which an archive is closed, at the end of a record.
ARCHIVE_BYTES = 64 << 20
LEVEL = 4
#: Bytes of first pages up to which they are broadcast, and tasks over which the copies of a payload are dealt beyond it.
BROADCAST_BYTES, SALTS = 32 << 20, 16


def with_types(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = DEDUP_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, n_bytes, record_type and refers_to.

    The first page of each payload that repeats comes from a pre-aggregation of (digest, page_id). These firsts are broadcast
    up to broadcast_bytes, and the html stays where it is; beyond that it is shuffled once, by digest and a salt, against
    firsts repeated for each salt, so the copies of a hot payload are dealt over SALTS tasks.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("n_bytes", F.octet_length("html").cast("long"))
    firsts = rows.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("first_digest"), "first")
    firsts = hold(firsts, "first-pages")
    again = (F.col("first").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("first"))
    on = (F.col("digest") == F.col("first_digest")) & (F.col("n_bytes") >= least)
    if firsts.count() * 100 <= broadcast_bytes:
        firsts = F.broadcast(firsts)
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        firsts = firsts.withColumn("_first_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (F.col("_salt") == F.col("_first_salt"))
    return rows.join(firsts, on, "left").select("page_id", "url", "html", "digest", "n_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _slices(payload: bytes) -> Iterator[memoryview]:
    view = memoryview(payload)
    for a in range(0, len(view), CHUNK):
        yield view[a : a + CHUNK]


def write_record(put, page_id: int | None, url: str, payload: bytes, digest: str, n_bytes: int, kind: str, refers_to: int | None) -> None:
    """Writes one record with put(bytes); a revisit has headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    length = len(http) + (len(payload) if kind == "response" else 0)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Bytes: {n_bytes}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    if kind == "revisit":
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    put(("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass"))
    put(http)
    if kind == "response":
        for x in _slices(payload):
            put(x)
    put(b"\r\n\r\n")


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of with_types() as archives; returns their manifest (path, records, bytes)."""
    tune(typed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        store.create_dir(root, recursive=True)
        out, path, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

        names = ("page_id", "url", "digest", "n_bytes", "record_type", "refers_to")
        for batch in batches:
            html = batch.column("html")
            for i, (page, url, digest, n, kind, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if out is None:
                    path, records, size = f"{root}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

                def put(data, member=member, out=out):
                    nonlocal size
                    if packed := member.compress(data):
                        size += out.write(packed) or len(packed)

                write_record(put, page, url, html[i].as_buffer() if kind == "response" else b"", digest, n, kind, first)
                rest = member.flush()
                out.write(rest)
                size += len(rest)
                records += 1
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return hold(typed.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class Inflater(io.RawIOBase):
    """The inflated bytes of a file of gzip members, read piece by piece."""

    def __init__(self, raw, piece: int = 1 << 18):
        self.raw, self.piece, self.member, self.left = raw, piece, None, b""
        self.buffer = bytearray()

    def _more(self) -> bool:
        data = self.left or self.raw.read(self.piece)
        self.left = b""
        if not data:
            return False
        if self.member is None or self.member.eof:
            self.member = zlib.decompressobj(31)
        self.buffer += self.member.decompress(data, CHUNK)
        self.left = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def take(self, n: int) -> bytes:
        """Exactly n bytes, or fewer at the end."""
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def until(self, mark: bytes) -> bytes:
        """Up to and with mark; what is left where there is none."""
        at = 0
        while (i := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                i = len(self.buffer) - len(mark)
                break
        return self.take(max(0, i + len(mark)))


def headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.lower()] = value.strip()
    return out


def record_chunks(raw, chunk: int = CHUNK) -> Iterator[tuple]:
    """(record_id, page_id, record_type, url, refers_to, chunk_no, data, digest so far, payload bytes so far, last) of an
    archive's records. A revisit has one row without data, with its payload's digest and length."""
    stream = Inflater(raw)
    while block := stream.until(b"\r\n\r\n"):
        head = headers(block)
        length = int(head["content-length"])
        number = lambda name: int(head[name]) if head.get(name) else None  # noqa: B023, E731
        fixed = (head["warc-record-id"], number("x-page-id"), head["warc-type"], head.get("warc-target-uri", ""), number("x-refers-to-page-id"))
        http = stream.until(b"\r\n\r\n")
        left = length - len(http)
        if head["warc-type"] == "revisit":
            yield *fixed, 0, None, head["warc-payload-digest"].removeprefix("sha256:"), number("x-payload-bytes"), True
        else:
            digest, n, seen = hashlib.sha256(), 0, 0
            while True:
                data = stream.take(min(chunk, left - seen))
                digest.update(data)
                seen += len(data)
                yield *fixed, n, data, digest.hexdigest(), seen, seen == left
                n += 1
                if seen == left:
                    break
                if not data:
                    raise ValueError(f"record {fixed[0]} ends early")
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {fixed[0]} has no end")


CHUNKS = "record_id string, page_id long, record_type string, url string, refers_to long, chunk_no long, data binary, sha256_so_far string, bytes_so_far long, last boolean"
_KINDS = [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("sha256_so_far", pa.string()), ("bytes_so_far", pa.int64()), ("last", pa.bool_())]


def read_chunks(manifest: DataFrame, folder: str, chunk: int = CHUNK, columns: list[str] | None = None) -> DataFrame:
    """The chunked record table of the manifest's archives; columns: which of its columns leave the reader."""
    kinds = [k for k in _KINDS if columns is None or k[0] in columns]
    which = [i for i, k in enumerate(_KINDS) if k in kinds]
    schema = ", ".join(x for x in CHUNKS.split(", ") if x.split()[0] in dict(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_fs(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as raw:
                    for row in record_chunks(raw, chunk):
                        rows.append([row[i] for i in which])
                        held += len(row[6] or b"") if any(k[0] == "data" for k in kinds) else 0
                        if len(rows) >= 1000 or held >= 4 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k[1]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k[0] for k in kinds])
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k[1]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k[0] for k in kinds])

    n = max(8, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("path").repartition(n).mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    manifest = write_archives(with_types(read_table(spark, sf_dir, "pages")), folder)
    chunks = read_chunks(manifest, folder, columns=["page_id", "record_type", "refers_to", "sha256_so_far", "bytes_so_far", "last"])
    return chunks.where("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha256_so_far").alias("payload_digest"), "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest AS digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f ON payload_digest = digest AND payload_bytes >= 100
"""
