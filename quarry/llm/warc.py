"""WARC archives: written as whole-file gzip streams, normalised to a gzip member per record with an offset index,
and read back by the index.

Writing: each task writes archives into the shared folder, as one gzip stream per file. Of pages with equal
payloads the one with the smallest page_id becomes a response, the others revisit it. Normalising inflates each
stream once, in chunks, rewrites every record as its own member and writes `<archive>.idx`, whose lines hold offset,
length, record type and record id. Reading takes the sidecars and opens members at their offsets.

Null html is an empty payload; null urls are empty. Records are found by the digest of the whole payload. Rows that
repeat a page are each written; of equal rows that hold the smallest page_id each is a response. Rows with a null
page_id are written with an empty id and read back as null. An empty table gives empty results. Columns beside
page_id, url and html are ignored. File names carry the task attempt, and only files of tasks that succeeded are listed.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import shared_path, written

#: Payload bytes after which a new archive begins, bytes read at once, and the gzip level.
ROLL, CHUNK, LEVEL = 32 << 20, 1 << 20, 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store_of(uri: str):
    """(file system, path) of a URI, by Arrow: local, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def bare(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {bare(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    stream = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return stream.compress(data) + stream.flush()


def inflated(source) -> Iterator[bytes]:
    """Chunks of the content of a gzip stream, of one member or many: CHUNK bytes at most, however well it is packed."""
    stream = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            if stream.eof:
                stream = zlib.decompressobj(31)
            yield stream.decompress(data, CHUNK)
            data = stream.unconsumed_tail or stream.unused_data
    while not stream.eof and (rest := stream.decompress(b"", CHUNK)):
        yield rest


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of a stream of chunks; holds one record and one chunk."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            headers = headers_of(bytes(held[at:end]))
            stop = end + 4 + int(headers.get("content-length", 0)) + 4
            if stop > len(held):
                break
            yield headers, bytes(held[at:stop])
            at = stop
        del held[:at]
    if held.strip():
        raise ValueError("an archive ends inside a record")


def page_of(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes one record per row and returns the archives' URIs (column archive)."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload).alias("digest"))
    digests = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    equal = digests.where(F.col("n") >= min_revisit_bytes)
    first = equal.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # distinct: a repeated row must not multiply; the null-safe test keeps null ids apart from the first one
    revisits = (
        equal.drop("n")
        .join(first.drop("n"), "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select("page_id", "digest", "first")
        .distinct()
    )
    joined = rows.join(
        revisits.withColumnsRenamed({"page_id": "p", "digest": "d"}),
        F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")),
        "left",
    ).select("page_id", "url", "html", "digest", F.col("first").cast("long").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, store, out, stream = TaskContext.get(), None, None, None
        names, size = [], 0

        def close() -> None:
            if out is not None:
                out.write(stream.flush())
                out.close()

        for batch in batches:
            if store is None:
                store, base = store_of(folder)
                store.create_dir(base, recursive=True)
            for page, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or size >= ROLL:
                    close()
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(names)}.warc.gz"
                    names.append(f"{folder}/{name}")
                    out, stream, size = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                body = html.encode()
                size += len(body)
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                out.write(stream.compress(record(page, url, body, digest, refers_to)))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])

    return written(joined.mapInArrow(write, "archive string"), "archives")


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrites each archive with a member per record beside it; returns the index: archive, offset, length,
    record_type, record_id."""
    schema = "archive string, offset long, length long, record_type string, record_id string"

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for uri in batch["archive"]:
                store, path = store_of(uri)
                stem = f"{path.removesuffix('.warc.gz')}-{attempt}.members"
                index, at = [], 0
                target = f"{uri.removesuffix('.warc.gz')}-{attempt}.members.warc.gz"
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(f"{stem}.warc.gz", compression=None) as out:
                    for headers, whole in records(inflated(source)):
                        member = gzipped(whole)
                        out.write(member)
                        index.append((target, at, len(member), headers["warc-type"], headers["warc-record-id"]))
                        at += len(member)
                with store.open_output_stream(f"{stem}.warc.gz.idx", compression=None) as out:
                    out.write("".join(f"{o} {n} {t} {i}\n" for _, o, n, t, i in index).encode())
                yield pd.DataFrame(index, columns=["archive", "offset", "length", "record_type", "record_id"])

    spread = archives.repartition(max(1, 2 * archives.sparkSession.sparkContext.defaultParallelism), "archive")
    return written(spread.mapInPandas(rewrite, schema), "index")


def read_index(archives: DataFrame) -> DataFrame:
    """The index as the sidecar files beside the normalised archives tell it (archives: column archive)."""
    schema = "archive string, offset long, length long, record_type string, record_id string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["archive"]:
                store, path = store_of(uri)
                with store.open_input_stream(f"{path}.idx", compression=None) as source:
                    lines = [line.split(" ", 3) for line in source.read().decode().splitlines()]
                rows = [(uri, int(o), int(n), kind, name) for o, n, kind, name in lines]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return archives.select("archive").distinct().mapInPandas(read, schema)


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of the indexed records: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if wanted,
    payload (null for revisits). Digests of responses are taken from the payload read and must agree with the header."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != opened:
                    store, path = store_of(archive)
                    opened, source = archive, store.open_input_file(path)
                source.seek(offset)
                whole = zlib.decompress(source.read(length), 31)
                head, _, rest = whole.partition(b"\r\n\r\n")
                headers = headers_of(head)
                http, _, body = rest.partition(b"\r\n\r\n")
                body = body[:-4]
                kind = headers["warc-type"]
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"{archive} at {offset}: payload and digest disagree")
                refers = headers.get("warc-refers-to")
                size = int(headers_of(http)["content-length"])
                row = (page_of(headers["warc-record-id"]), headers["warc-target-uri"], size, digest, kind, page_of(refers) if refers else None)
                out.append((*row, body if kind == "response" else None)[: len(columns)])
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            arrays = [pa.array([r[k] for r in out], kinds[k]) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return index.select("archive", "offset", "length").mapInArrow(read, schema + ", payload binary" * payloads)
