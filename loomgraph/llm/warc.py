"""WARC archives through a chunked record table.

A payload is a run of rows (record, chunk number, data) of at most `chunk` bytes each, made in the JVM next to its page and
without a shuffle of its own; the writer sees one chunk at a time and so never holds a whole record. It streams the chunks
into one gzip member per record; every task writes an archive of its own to the shared folder under a name that no other
attempt has, and returns the index of what it wrote. Archives of lost attempts are in no index, so a repeated task does no
harm. The reader seeks to each record of the index, inflates it chunk by chunk, and emits chunk rows again, with a SHA-1 that
is carried along; the last chunk of a record has the digest of the whole payload.

Records with equal payloads of `revisit_from` bytes or more: the one with the smallest key is a response, the others are
revisits of it. Smaller ones are all responses. Equal payloads are found by digest with an aggregate of narrow rows (partial sums
before the shuffle). What repeats is a written table, which is joined back: as a broadcast where its rows are few enough, and
then no payload is shuffled; else as a join of two plain shuffles, in which the skew join splits a payload that a third of all
pages share.

Defined cases: null html is the empty payload; a null key sorts after all others and reads back as null; keys of any text read
back as they were (percent-encoded in the header); rows repeated with key and payload are each a response; an empty table makes
no archive and an empty result; payloads of any size go through in chunks; columns besides key, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard_folder, materialize, shared_dir, small, temporary_tables

CHUNK = 1 << 20
_DATE = b"2024-01-01T00:00:00Z"  # archives of the same pages are the same bytes
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "archive string, at long, compressed long"


def _b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, as a full address that tasks can open."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    at = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{at.replace('file:/', 'file:///', 1) if at.startswith('file:/') and not at.startswith('file:///') else at}/warc/{uuid.uuid4().hex}"


def records(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", revisit_from: int = 0) -> DataFrame:
    """key, url, payload, sha1 (hex), first (key of the response of a revisit, else null)."""
    # No expression stands between the scan and the digest but the cast: equal payloads have equal bytes.
    rows = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(body), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    long = F.octet_length("payload") >= revisit_from
    same = rows.filter(long).groupBy("sha1").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = small(materialize(same.select(F.col("sha1").alias("_sha1"), "least"), "warc-repeated"))
    joined = rows.join(same, (F.col("sha1") == F.col("_sha1")) & long, "left")
    return joined.select("key", "url", "payload", "sha1", F.when(~F.col("key").eqNullSafe(F.col("least")), F.col("least")).alias("first"))


def chunk_rows(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """records() as chunk rows: size and digest on each, data only in responses (a revisit has one chunk without data)."""
    data = F.when(F.col("first").isNull(), F.col("payload")).otherwise(F.lit(b""))
    cut = rows.withColumns({"size": F.octet_length("payload").cast("long"), "_data": data}).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.octet_length("_data") / chunk).cast("int")))
    cut = cut.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return cut.select("key", "url", "sha1", "first", "size", "chunks", "chunk_no", F.substring(F.col("_data"), F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data"))


def _name(key: str | None) -> bytes:
    return b"<urn:page>" if key is None else b"<urn:page:%s>" % quote(key, safe="").encode()


def _key(name: bytes | None) -> str | None:
    return None if name in (None, b"<urn:page>") else unquote(name[len("<urn:page:") : -1].decode())


def _header(record: str | None, url: str, sha1: bytes, first: str | None, size: int) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"response" if first is None else b"revisit"), b"WARC-Record-ID: " + _name(record), b"WARC-Date: " + _DATE]
    if url:
        lines.append(b"WARC-Target-URI: " + url.encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
    if first is not None:
        lines += [b"WARC-Refers-To: " + _name(first), b"WARC-Profile: " + _PROFILE]
    lines += [b"WARC-Payload-Digest: sha1:" + _b32(sha1).encode(), b"Content-Type: application/http; msgtype=response"]
    lines.append(b"Content-Length: %d" % (len(http) + (size if first is None else 0)))
    return b"\r\n".join(lines) + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write chunk rows as .warc.gz archives in folder; returns their index (archive, at, compressed), one row per record."""
    bounded_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, out, at, zipped, begun = "", None, 0, None, 0
        try:
            for batch in batches:
                index: list[tuple[str, int, int]] = []
                for x in batch.to_pylist():
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    if x["chunk_no"] == 0:
                        begun, zipped = at, zlib.compressobj(level, zlib.DEFLATED, 31)
                        at += out.write(zipped.compress(_header(*(None if x[c] is None else str(x[c]) for c in ("key", "url")), bytes.fromhex(x["sha1"]), None if x["first"] is None else str(x["first"]), x["size"])))
                    at += out.write(zipped.compress(x["data"]))
                    if x["chunk_no"] == x["chunks"] - 1:
                        at += out.write(zipped.compress(b"\r\n\r\n") + zipped.flush())
                        index.append((f"{folder}/{name}", begun, at - begun))
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "at", "compressed"])
        finally:
            if out is not None:
                out.close()

    return chunks.mapInArrow(run, _INDEX)


def _inflated(stream, at: int, size: int, chunk: int) -> Iterator[bytes]:
    """A gzip member in pieces of at most chunk bytes."""
    stream.seek(at)
    z, rest = zlib.decompressobj(31), b""
    while not z.eof:
        if not rest:
            rest = stream.read(min(size, chunk))
            size -= len(rest)
            if not rest:
                raise ValueError("a record of an archive ends early")
        yield z.decompress(rest, chunk)
        rest = z.unconsumed_tail


def read_record(pieces: Iterator[bytes], chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of one record; memory holds the headers and at most two chunks."""
    held = b""
    while b"\r\n\r\n" not in held:
        held += next(pieces)
    head, held = held.split(b"\r\n\r\n", 1)
    fields = {k.strip().lower(): v.strip() for k, v in (line.split(b":", 1) for line in head.split(b"\r\n")[1:])}
    while b"\r\n\r\n" not in held:
        held += next(pieces)
    http, held = held.split(b"\r\n\r\n", 1)
    left = int(fields[b"content-length"]) - len(http) - 4
    told = {k.strip().lower(): v.strip() for k, v in (line.split(b":", 1) for line in http.split(b"\r\n")[1:])}
    row = {"key": _key(fields[b"warc-record-id"]), "record_type": fields[b"warc-type"].decode(), "refers_to": _key(fields.get(b"warc-refers-to"))}
    if row["record_type"] == "revisit":
        yield row | {"chunk_no": 0, "data": b"", "last": True, "payload_bytes": int(told[b"content-length"]), "payload_digest": fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode()}
        return
    digest, n, total = hashlib.sha1(), 0, left
    while True:
        while len(held) < min(left, chunk):
            held += next(pieces)
        data, held = held[: min(left, chunk)], held[min(left, chunk) :]
        left -= len(data)
        digest.update(data)
        if not left and _b32(digest.digest()) != fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode():
            raise ValueError(f"record {row['key']}: its payload does not have its digest")
        yield row | {"chunk_no": n, "data": data, "last": not left, "payload_bytes": total - left, "payload_digest": None if left else _b32(digest.digest())}
        if not left:
            return
        n += 1


_READ = (("key", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary()))


def read_archives(index: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of the records in index: key (string), record_type, refers_to, chunk_no, last, payload_bytes (so far), payload_digest (on the last), data."""
    columns = _READ if with_data else _READ[:-1]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in columns], names=[c for c, _ in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        for batch in batches:
            rows, held = [], 0
            for x in batch.to_pylist():
                if x["archive"] != opened:
                    if stream is not None:
                        stream.close()
                    store, path = fs.FileSystem.from_uri(x["archive"])
                    opened, stream = x["archive"], store.open_input_file(path)
                for row in read_record(_inflated(stream, x["at"], x["compressed"], chunk), chunk):
                    if with_data or row["last"]:
                        rows.append(row)
                        held += len(row["data"]) if with_data else 1
                    if held >= 8 * chunk or len(rows) >= 4000:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)
        if stream is not None:
            stream.close()

    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return index.mapInArrow(run, ", ".join(f"{c} {kinds[k]}" for c, k in columns))


def archive_pages(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", revisit_from: int = 0, chunk: int = CHUNK, folder: str | None = None) -> DataFrame:
    """Write df as archives; the written index (archive, at, compressed)."""
    return materialize(write_archives(chunk_rows(records(df, key, url, body, revisit_from), chunk), folder or archive_folder(df.sparkSession)), "warc-index")


def round_trip(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", revisit_from: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write df as archives and read them back: key, payload_bytes, payload_digest, record_type, refers_to. The archives go then."""
    kind, folder = dict(df.dtypes)[key], archive_folder(df.sparkSession)
    with temporary_tables() as keep:
        index = archive_pages(df, key, url, body, revisit_from, chunk, folder)
        back = read_archives(index, with_data=False, chunk=chunk).filter("last")
        out = keep(materialize(back.select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")), "warc-read"))
    discard_folder(df.sparkSession, folder)
    return out
