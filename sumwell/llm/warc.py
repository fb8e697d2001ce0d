"""WARC archives, written and read as a chunked record table.

A record never stands in one piece: its payload travels as rows
(record_id, chunk_no, data), written in order with a running SHA-1, and is
read back as such rows, each with the digest of the payload up to there.
Memory holds one chunk per task, whatever the size of a record.

Archives are gzip files with one member per record, in the folder that the
cluster shares.  A task writes under a name of its own attempt and reports it
in a manifest; only files in the manifest are read, so attempts that were
lost or repeated leave nothing in the result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwell.llm.scratch import Scratch, most_frequent

#: Bytes of a chunk.
CHUNK = 1 << 18
#: Bytes that an archive has about at most, and that a reader's task takes.
ARCHIVE_BYTES, TASK_BYTES = 1 << 28, 1 << 26
#: Repeated payloads that are broadcast, the most frequent ones (about 80 bytes each).
MAX_BROADCAST = 100_000
_LEVEL = 4
#: Fixed values of the format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_URN = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122 name space for URLs


def _open(path: str, write: bool = False):
    """A file of the shared folder; local paths directly, other stores through Arrow's file systems."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        if write:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb" if write else "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if write:
        store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner, compression=None) if write else store.open_input_stream(inner, compression=None)


def record_urn(key: int | str | None, digest_hex: str) -> str:
    """Name of a record: pages may share a page_id, but then not the payload."""
    return f"<urn:uuid:{uuid.uuid5(_URN, f'{key}/{digest_hex}')}>"


def base32_sha1(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a hex SHA-1: 160 bits are 32 digits of 5, without padding."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = []
    for g in range(4):  # 10 hex digits are 40 bits are 8 letters
        value = F.conv(F.substring(hex_digest, 10 * g + 1, 10), 16, 10).cast("long")
        groups += [F.substring(letters, (F.shiftright(value, 35 - 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*groups)


def _with_payload(pages: DataFrame) -> DataFrame:
    """page_id, url, body, size and digest (hex SHA-1) of every row."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body")).select(
        "*", F.octet_length("body").cast("long").alias("size"), F.sha1("body").alias("digest")
    )


def repeated_payloads(pages: DataFrame, min_bytes: int) -> DataFrame:
    """digest, last (the largest page_id) and n of the payloads of at least ``min_bytes`` bytes that occur more than once."""
    rows = _with_payload(pages).where(F.col("size") >= min_bytes)
    return rows.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")


def join_by_digest(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Left join of rows with a table (digest, last, n) of one row per digest.

    The rows of the MAX_BROADCAST digests that occur most often are decided
    where they are; if the table has more, the other rows are shuffled, and none of
    their digests is frequent.
    """
    heavy = most_frequent(table, "n", MAX_BROADCAST)
    n, held = table.count(), heavy.count()
    if held == n:
        return rows.join(F.broadcast(heavy), "digest", "left")
    near = rows.join(F.broadcast(heavy), "digest")
    far = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return near.unionByName(far.join(table.join(F.broadcast(heavy.select("digest")), "digest", "left_anti"), "digest", "left"))


def chunk_rows(pages: DataFrame, again: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(record_id, url, size, digest, refers_to, chunk_no, data): payloads cut in the JVM, in record order per partition.

    Each row of ``pages`` gives one record.  Revisits carry no payload and so
    one empty chunk.
    """
    p = join_by_digest(_with_payload(pages), again).withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")))
    last = F.when(F.col("refers_to").isNotNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(F.col("size") / chunk).cast("int") - 1))
    p = p.select("page_id", "url", "size", "digest", "refers_to", "body", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    data = F.when(F.col("refers_to").isNull(), F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return p.select(F.col("page_id").alias("record_id"), "url", "size", "digest", "refers_to", "chunk_no", data.alias("data"))


def _header(record_id, url, size, digest_hex, refers_to) -> bytes:
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_urn(record_id, digest_hex)}", f"WARC-Date: {_DATE}"]
    lines += [f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {record_id}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_urn(refers_to, digest_hex)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: text/html", f"Content-Length: {size if refers_to is None else 0}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the chunk rows of each partition to archives; gives the manifest (file, records, bytes).

    An archive ends with the first record that brings it to ``archive_bytes``.
    A record whose running digest differs from its plan stops the job.
    """
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        path = out = gz = sha = want = key = None
        records = written = 0

        def put(data: bytes):
            nonlocal written
            written += len(data)
            out.write(data)

        def close():
            if gz is not None:
                if want is not None and sha.hexdigest() != want:
                    raise ValueError(f"record {key}: its payload has another digest")
                put(gz.compress(b"\r\n\r\n") + gz.flush())

        def entry():
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records]), pa.array([written])], schema=schema)

        for b in batches:
            for record_id, url, size, digest, refers_to, chunk_no, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk_no == 0:
                    close()
                    if written >= archive_bytes:
                        out.close()
                        yield entry()
                        out, records, written = None, 0, 0
                    if out is None:
                        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        out = _open(path, write=True)
                    gz, sha, key, want = zlib.compressobj(_LEVEL, wbits=31), hashlib.sha1(), record_id, digest if refers_to is None else None
                    put(gz.compress(_header(record_id, url, size, digest, refers_to)))
                    records += 1
                sha.update(data)
                put(gz.compress(data))
        if out is not None:
            close()
            out.close()
            yield entry()

    return rows.mapInArrow(run, "file string, records long, bytes long")


def _blocks(path: str) -> Iterator[bytes]:
    """The decompressed bytes of an archive, in blocks; gzip members follow each other."""
    with _open(path) as f:
        gz = zlib.decompressobj(wbits=31)
        while data := f.read(1 << 16):
            while data:
                if block := gz.decompress(data, CHUNK):
                    yield block
                if gz.eof:
                    data, gz = gz.unused_data, zlib.decompressobj(wbits=31)
                else:
                    data = gz.unconsumed_tail


def read_records(path: str, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, str, bool]]:
    """(headers, chunk_no, data, hex SHA-1 up to this chunk, last) of each record of an archive, streamed."""
    blocks, held = _blocks(path), bytearray()

    def fill() -> bool:
        block = next(blocks, None)
        if block is None:
            return False
        held.extend(block)
        return True

    def need(n: int) -> bytes:
        while len(held) < n:
            if not fill():
                raise ValueError(f"{path} ends inside a record")
        out = bytes(held[:n])
        del held[:n]
        return out

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                if held:
                    raise ValueError(f"{path} ends inside a header")
                return
        lines = need(end + 4)[:-4].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{path}: no record starts here")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        left, k, sha = int(headers["Content-Length"]), 0, hashlib.sha1()
        while True:
            data = need(min(left, chunk))
            left -= len(data)
            sha.update(data)
            yield headers, k, data, sha.hexdigest(), left == 0
            k += 1
            if not left:
                break
        if need(4) != b"\r\n\r\n":
            raise ValueError(f"{path}: a record has another length than it says")


def read_archives(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in a manifest.

    Columns: record_id, url, record_type, refers_to, payload_length,
    payload_digest (as the header says), chunk_no, data, digest_so_far (hex),
    bytes_so_far (as they were read) and last.  Without data, only the last
    row of each record is given.
    """
    fields = [("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_length", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("digest_so_far", pa.string()), ("bytes_so_far", pa.int64()), ("last", pa.bool_())]
    schema = pa.schema(fields)

    def number(x: str | None):
        return None if x in (None, "None") else int(x)

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size, count = [], 0, 0
                for h, k, data, so_far, last in read_records(path, chunk):
                    count = len(data) + (count if k else 0)
                    if not (with_data or last):
                        continue
                    rows.append((number(h.get("X-Page-ID")), h.get("WARC-Target-URI"), h["WARC-Type"], number(h.get("X-Refers-To-Page")), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), k, data if with_data else None, so_far, count, last))
                    size += len(data) if with_data else 100
                    if len(rows) >= 4096 or size > 8 * chunk:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    facts = manifest.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = min(facts["n"], max(manifest.sparkSession.sparkContext.defaultParallelism * 4, -(-(facts["bytes"] or 0) // TASK_BYTES)))
    return manifest.select("file").repartition(max(1, tasks)).mapInArrow(run, "record_id long, url string, record_type string, refers_to long, payload_length long, payload_digest string, chunk_no long, data binary, digest_so_far string, bytes_so_far long, last boolean")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK, scratch: Scratch | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html), read the archives back, and describe the records.

    Gives page_id, payload_bytes, payload_digest (base32 SHA-1), record_type,
    refers_to, verified and url, one row per row of ``pages``.  Bytes and
    digest are those that were read; a revisit has those of the response that
    it refers to, which is looked up by page and digest.  verified tells
    whether they agree with the record's own header.

    Null html is an empty payload.  Of equal payloads, also empty ones, the
    largest page_id is the response.  Repeated rows give a record each; those
    of the response's page are responses too.  Rows that share a page_id and
    differ in html are records of their own.  A null page_id is smaller than
    any other; payloads that only such rows hold are responses.  An empty table gives
    no archive and no row.  Payloads of any size go through in chunks.
    Further columns are ignored.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    again = scratch.write(repeated_payloads(pages, min_bytes), "again")
    manifest = scratch.write(write_archives(chunk_rows(pages, again, chunk), scratch.path("archives")), "manifest")
    records = scratch.write(read_archives(manifest, chunk, with_data=False).where("last"), "records")
    response = F.col("record_type") == "response"
    read = records.where(response).select(F.col("record_id").alias("page"), base32_sha1(F.col("digest_so_far")).alias("digest"), "bytes_so_far")
    # the response of each payload that revisits refer to, found among the responses by page and digest
    asked = records.where(~response).groupBy(F.col("payload_digest").alias("digest"), F.col("refers_to").alias("page")).agg((F.count("*") + 1).alias("n"))
    met = scratch.write(asked.join(read.dropDuplicates(["page", "digest"]), ["digest", "page"]), "met")
    rows = records.select(F.col("record_id").alias("page_id"), F.col("payload_digest").alias("digest"), "record_type", "refers_to", "payload_length", "url", "bytes_so_far", base32_sha1(F.col("digest_so_far")).alias("own"))
    out = join_by_digest(rows, met.select("digest", F.col("page").alias("last"), "n", F.col("bytes_so_far").alias("there")))
    revisit = F.col("record_type") == "revisit"
    found = F.col("last").eqNullSafe(F.col("refers_to"))
    size = F.when(revisit, F.when(found, F.col("there"))).otherwise(F.col("bytes_so_far"))
    same = F.when(revisit, found).otherwise(F.col("own") == F.col("digest")) & F.coalesce(size == F.col("payload_length"), F.lit(False))
    return out.select(
        "page_id", F.coalesce(size, "payload_length").alias("payload_bytes"), F.when(revisit, F.col("digest")).otherwise(F.col("own")).alias("payload_digest"), "record_type", "refers_to", F.coalesce(same, F.lit(False)).alias("verified"), "url"
    )
