"""WARC archives in Zstandard, written and read back.

An archive is a leading skippable frame (magic 0x184D2A5D) with a dictionary, then one Zstandard frame per record. A record is
WARC/1.1 with an HTTP response as its block; a `revisit` has the HTTP header alone and names the record it repeats. Tasks write
archives of at most `ARCHIVE_BYTES` under names of their own attempt to the shared folder; the manifest lists those of the
attempts that counted, so retried tasks do no harm. Reading goes by archives; a record is in memory at a time.

Of records with equal payloads of at least `MIN_SHARED` bytes, the one with the smallest id is a response and the others revisit
it; smaller payloads are all responses.

Rows: null html is an empty payload; a null url has no WARC-Target-URI. Repeated rows that share the smallest id are all
responses; rows with a null id are too if no id of their payload is known, else they revisit it. The payload, however long, is kept whole.
An empty table gives no archives and no rows. Reading raises ValueError for a broken header, length, digest or a frame
that is not one record. WARC-Date is fixed, as pages carry no time.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretally.llm.store import shared_folder, table

MIN_SHARED = 100
ARCHIVE_BYTES = 64 << 20
#: The dictionary is trained on so many pages at most (those with the smallest hash of their id), on so many characters of each.
DICTIONARY_PAGES, DICTIONARY_CHARS, DICTIONARY_BYTES = 400, 20_000, 64 << 10
SKIPPABLE = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20


def dictionary(pages: DataFrame) -> bytes:
    """A trained dictionary, or nothing where there are too few pages to train one."""
    order = [F.xxhash64("page_id"), F.col("page_id")]
    chosen = pages.where("html IS NOT NULL AND page_id IS NOT NULL").select("page_id").orderBy(*order).limit(DICTIONARY_PAGES)
    # Ids are chosen first: a sorted limit over the pages would have every task send as many pages to the driver.
    sample = pages.join(F.broadcast(chosen), "page_id").select("page_id", F.substring("html", 1, DICTIONARY_CHARS).alias("html")).orderBy("page_id", "html").limit(DICTIONARY_PAGES)
    texts = [r["html"].encode() for r in sample.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Fields of one record; ValueError if anything about it is wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon or name.lower() in fields:
            raise ValueError(f"broken header line {line!r}")
        fields[name.lower()] = value
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the record's length is not that of its header")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    sizes = [x[16:] for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")]
    if not found or not http.startswith(b"HTTP/1.1 ") or len(sizes) != 1 or not sizes[0].isdigit():
        raise ValueError("the block is no HTTP response")
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        if len(payload) != int(sizes[0]) or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload is not that of its headers")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields or len(digest) != 64:
        raise ValueError(f"not a response or a proper revisit: {kind}")

    def page(name: str) -> int | None:
        number = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "payload_bytes": int(sizes[0]), "payload_digest": digest, "record_type": kind,
            "refers_to": page("warc-refers-to"), "payload": payload if kind == "response" else None}


def frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, one by one, with the dictionary of its leading skippable frame."""
    start = stream.read(8)
    known = None
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", start[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut short")
        if raw[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known, start = zstandard.ZstdCompressionDict(raw), b""
    decoder = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    left = start
    while True:
        left = left or stream.read(CHUNK)
        if not left:
            return
        one, parts = decoder.decompressobj(), []
        while not one.eof:
            if not left and not (left := stream.read(CHUNK)):
                raise ValueError("the last frame is cut short")
            try:
                parts.append(one.decompress(left))
            except zstandard.ZstdError as e:
                raise ValueError(f"broken frame: {e}") from e
            left = b""
        left = one.unused_data
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html); returns the manifest: path, records, bytes."""
    spark: SparkSession = pages.sparkSession
    folder = folder or shared_folder(spark)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = (rows.where(F.octet_length("html") >= MIN_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    marked = rows.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))
    known = dictionary(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(known)) if known else zstandard.ZstdCompressor(level=3)
        made, out = [], None
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(made):04d}.warc.zst"
                    out, records, written = fs.open_output_stream(os.path.join(base, name)), 0, 0
                    if known:
                        written += out.write(struct.pack("<II", SKIPPABLE, len(known)) + known)
                written += out.write(coder.compress(record(page_id, url, html.encode(), digest, refers_to)))
                records += 1
                if written >= ARCHIVE_BYTES:
                    out.close()
                    made.append((name, records, written))
                    out = None
        if out is not None:
            out.close()
            made.append((name, records, written))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{m[0]}" for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["path", "records", "bytes"])

    return table(marked.mapInArrow(write, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for every record of the archives that `manifest` lists by `path`; with `payloads`, url and payload too (null payload
    for revisits)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * payloads
    kinds = dict(page_id=pa.int64(), payload_bytes=pa.int64(), payload_digest=pa.string(), record_type=pa.string(), refers_to=pa.int64(), url=pa.string(), payload=pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_stream(place) as stream:
                    for raw in frames(stream):
                        rows.append(parsed(raw))
                        held += len(raw) if payloads else 200
                        if held >= CHUNK:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from archives written and read."""
    return read_archives(write_archives(pages), payloads=False)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
