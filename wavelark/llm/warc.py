"""WARC archives under Zstandard with a dictionary of their own.

An archive starts with a skippable frame that holds a dictionary built from its own records; each
record is a frame of its own, compressed with it. Records of equal payloads are found by digest over
the whole table: one is written as response, the others as revisits that refer to it.

Tasks write through pyarrow's file systems to a folder that all executors share, each archive under a
name of its own; only archives that a finished task lists are read, so lost or repeated tasks leave
no trace in the result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, new_path, parallelism, stage, text_or_empty

#: The magic number of the dictionary's frame, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of records in an archive, of its dictionary, and of the records it is trained on, at most.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAINING_BYTES = 24 << 20, 32 << 10, 2 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:wavelark:page:{'null' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    found = name.strip("<>").rpartition(":")[2]
    return None if found == "null" else int(found)


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]):
    """Trained on records evenly spread over the archive; from their bytes as they are where too few are there to train on."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING_BYTES))
    sample = [r[: 64 << 10] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: list[bytes], level: int = 3) -> None:
    import zstandard

    dictionary = build_dictionary(records)
    raw = dictionary.as_bytes()
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    for r in records:
        out.write(compressor.compress(r))


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, one at a time."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(source.read(size))
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True), 1 << 20)
    while first := stream.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError(f"a record starts with {first[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            headers[key.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block


def _files(where: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(where if "://" in where or where.startswith("file:") else f"file://{where}")


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html, ...) -> archive, records, bytes: one row per archive written below folder.

    Of records with equal payloads of at least min_revisit_bytes bytes, that with the largest page_id is
    the response and the others revisit it; rows that share that page_id are all responses. Null html is
    an empty payload. A null page_id is smaller than any other; where all are null, all are responses.
    """
    rows = bounded_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", text_or_empty("html").alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    shared = rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("sha", "first")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = rows.join(shared, "sha", "left").select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            buffer = io.BytesIO()
            write_archive(buffer, held)
            with files.open_output_stream(path) as out:
                out.write(buffer.getbuffer())
            row = pa.RecordBatch.from_pydict({"archive": [path.rpartition("/")[2]], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([buffer.tell()], pa.int64())})
            held.clear()
            return row

        for b in batches:
            ids, urls, payloads, revisits, refers = b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()
            for page_id, url, payload, is_revisit, to in zip(ids, urls, payloads, revisits, refers, strict=True):
                held.append(format_record(page_id, url, payload, payload_digest(payload), to, is_revisit))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return marked.mapInArrow(run, "archive string, records long, bytes long")


def read_warc(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """archives(archive, ...) below folder -> page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest is computed from its payload and must equal its header's; a revisit's length and
    digest, of the full payload, come from its headers, and its payload is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for archive in b.column(0).to_pylist():
                rows: list[tuple] = []
                with files.open_input_stream(f"{base}/{archive}") as source:
                    for h, block in read_archive(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
                        if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
                            raise ValueError(f"payload of {h['warc-record-id']} doesn't have its digest")
                        rows.append((_id(h["warc-record-id"]), h.get("warc-target-uri"), payload if with_payload and kind == "response" else None, length, digest, kind, _id(h["warc-refers-to"]) if kind == "revisit" else None))
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    n = parallelism(archives.sparkSession)
    return archives.select("archive").repartition(n).mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes archives to the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to per page."""
    spark: SparkSession = pages.sparkSession
    folder = new_path(spark, "warc")
    archives, _ = stage(write_warc(pages, folder, min_revisit_bytes), "archives")
    return read_warc(archives, folder, with_payload=False).drop("url", "payload")
