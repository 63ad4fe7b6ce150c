"""WARC archives: monolithic gzip writing, normalising to one member per record with a sidecar index, and reading back.

``write`` puts records into files that are one gzip stream each. ``normalise`` inflates such a stream once, front to back
in bounded memory, and rewrites every record as a gzip member of its own beside an index of ``offset length type id``
lines. ``read`` seeks by that index. All files are in the folder given, which must be shared; each task names its own
files and reports them in its rows, so a repeated task leaves stray files that nothing refers to.

Null html is an empty payload; a null page_id gives a record without a page id, read back as null. Of equal payloads the
smallest page_id (nulls last) is the response, the others revisit it; exactly repeated rows share the page_id, so each of
them with the smallest id is a response. Empty tables give no records. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, small_batches

DATE = "2024-01-01T00:00:00Z"
#: Raw bytes after which a writer begins its next file.
FILE_BYTES = 32 << 20


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(uri))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, refers_to, refers_url) -> bytes:
    """One WARC/1.1 record: a response, or with refers_to a revisit that holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {quote(refers_url or '', safe=':/?#[]@!$&()*+,;=%~')}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def header_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def records_in(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The raw records of a plain WARC stream; holds one record at a time."""
    held, ended = bytearray(), False
    while True:
        while (at := held.find(b"\r\n\r\n")) < 0 and not ended:
            held += (chunk := next(chunks, b""))
            ended = not chunk
        if at < 0:
            if held.strip():
                raise ValueError("the archive ends within a record's header")
            return
        need = at + 4 + int(header_of(bytes(held[:at]))["content-length"]) + 4
        parts, have = [], len(held)
        while have < need:
            if not (chunk := next(chunks, b"")):
                raise ValueError("the archive ends within a record")
            parts.append(chunk)
            have += len(chunk)
        held += b"".join(parts)
        yield bytes(held[:need])
        del held[:need]


def inflated(file, size: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a gzip file (one member or many), in pieces of bounded size."""
    inflate = zlib.decompressobj(31)
    while data := file.read(size):
        while data:
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            if out := inflate.decompress(data, 4 * size):
                yield out
            data = inflate.unconsumed_tail or inflate.unused_data
    if out := inflate.flush():
        yield out
    if not inflate.eof:
        raise ValueError("the gzip stream is cut short")


def decided(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with refers_to and refers_url, null for responses. Only ids, digests and urls are joined on digests."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    ids = p.select("page_id", "url", F.concat(F.sha1(F.col("html").cast("binary")), F.lit(":"), F.octet_length("html")).alias("digest"))
    first = F.min_by(F.struct(F.col("page_id").alias("leader"), F.col("url").alias("leader_url")), F.struct(F.col("page_id").isNull(), "page_id", "url"))
    leaders = cut(ids.groupBy("digest").agg(first.alias("f"), F.count("*").alias("n")).where("n > 1 and f.leader is not null").select("digest", "f.*"))
    links = ids.join(leaders, "digest").where(~F.col("page_id").eqNullSafe(F.col("leader"))).select("page_id", "digest", F.col("leader").alias("refers_to"), F.col("leader_url").alias("refers_url")).distinct()
    own = p.withColumn("digest", F.concat(F.sha1(F.col("html").cast("binary")), F.lit(":"), F.octet_length("html"))).alias("o")
    return own.join(links.alias("l"), F.col("o.page_id").eqNullSafe(F.col("l.page_id")) & (F.col("o.digest") == F.col("l.digest")), "left").select("o.page_id", "url", F.col("html").cast("binary").alias("payload"), "refers_to", "refers_url")


def _write(folder: str):
    def run(batches):
        fs, at = _fs(folder)
        fs.create_dir(at, recursive=True)
        name = out = squeeze = None
        raw = n = 0

        def ended():
            out.write(squeeze.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

        for batch in batches:
            for page_id, url, payload, to, to_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "refers_url"))):
                if out is None:
                    name, raw, n = f"mono-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, squeeze = fs.open_output_stream(f"{at}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                record = record_bytes(page_id, url, payload, to, to_url)
                out.write(squeeze.compress(record))
                raw, n = raw + len(record), n + 1
                if raw >= FILE_BYTES:
                    yield ended()
                    out = None
        if out is not None:
            yield ended()

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages(page_id, url, html) as monolithic archives below folder; one row (path, records) per file."""
    small_batches(pages.sparkSession, 256)
    return cut(decided(pages).mapInArrow(_write(folder), "path string, records long"))


def _normalise(folder: str):
    def run(batches):
        fs, at = _fs(folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name, offset, n = f"rec-{uuid.uuid4().hex}.warc.gz", 0, 0
                src_fs, src = _fs(path)
                with src_fs.open_input_stream(src, compression=None) as file, fs.open_output_stream(f"{at}/{name}", compression=None) as out, fs.open_output_stream(f"{at}/{name}.idx", compression=None) as idx:
                    for record in records_in(inflated(file)):
                        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = squeeze.compress(record) + squeeze.flush()
                        head = header_of(record[: record.index(b"\r\n\r\n")])
                        idx.write(f"{offset} {len(member)} {head['warc-type']} {head['warc-record-id']}\n".encode())
                        out.write(member)
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "index_path": [f"{folder}/{name}.idx"], "records": pa.array([n], pa.int64())})

    return run


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """files(path) of gzip WARCs, monolithic or not, rewritten below folder; one row (path, index_path, records) per file."""
    files = files.select("path").repartition(max(1, min(files.count(), 10_000)))
    return cut(files.mapInArrow(_normalise(folder), "path string, index_path string, records long"))


FIELDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, verified boolean"


def _parsed(record: bytes, payloads: bool) -> dict:
    end = record.index(b"\r\n\r\n")
    head = header_of(record[:end])
    block = record[end + 4 : end + 4 + int(head["content-length"])]
    http_end = block.index(b"\r\n\r\n")
    http = header_of(block[:http_end])
    payload = block[http_end + 4 :]
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">") or "0") if x and x != "<urn:page:>" else None
    response = head["warc-type"] == "response"
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    return {"page_id": number(head["warc-record-id"]), "url": unquote(head["warc-target-uri"]), "record_type": head["warc-type"], "refers_to": number(head.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": int(http["content-length"]), "payload": payload if response and payloads else None, "verified": (digest_of(payload) == digest and len(payload) == int(http["content-length"])) if response else None}


def _read(payloads: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("verified", pa.bool_())])

    def run(batches):
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist()):
                fs, at = _fs(path)
                with fs.open_input_stream(_fs(index)[1]) as lines, fs.open_input_file(at) as file:
                    rows, held = [], 0
                    for line in io.TextIOWrapper(lines, "utf-8"):
                        offset, length, *_ = line.split(" ")
                        file.seek(int(offset))
                        rows.append(_parsed(zlib.decompress(file.read(int(length)), 31), payloads))
                        held += len(rows[-1]["payload"] or b"")
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of normalised files(path, index_path), by their indexes. verified: a response's digest and length hold for its payload."""
    return files.select("path", "index_path").repartition(max(1, min(files.count(), 10_000))).mapInArrow(_read(payloads), FIELDS)


def roundtrip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """pages written, normalised and read back, below the shared folder."""
    folder = scratch(pages.sparkSession, "warc")
    return read(normalise(write(pages, f"{folder}/mono"), f"{folder}/records"), payloads)
