import base64
import hashlib
import io
from collections import defaultdict

import pytest
import zstandard
from pyspark.sql import types as T

from wavelark.llm.common import new_path, stage
from wavelark.llm.warc import format_record, payload_digest, read_archive, read_warc, round_trip, write_archive, write_warc

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("first", T.StringType()), T.StructField("sha", T.LongType())])


def brute(rows, least=0):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        top = max((x for x in groups[p] if x is not None), default=None)
        revisit = len(p) >= least and i != top
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def check(df, least=0):
    got = sorted((tuple(r) for r in round_trip(df, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == brute([(r.page_id, r.url, r.html) for r in df.collect()], least)


def test_pages(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "a\r\nb", "x" * 300_000), (4, "é", "x" * 300_000), (4, "é", "x" * 300_000), (None, "n", "x" * 300_000), (None, "n", "alone"), (7, "w", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA).repartition(2)
    check(df)
    check(df, 10)
    assert round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_payloads_come_back(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(50)
    folder = new_path(spark, "warc")
    archives, _ = stage(write_warc(df, folder, 1 << 30), "archives")
    assert {(r.page_id, r.payload.decode(), r.url) for r in read_warc(archives, folder).collect()} == {(r.page_id, r.html, r.url) for r in df.collect()}


def test_archive_layout():
    records = [format_record(i, "http://x/", f"<html>page {i} {'common text ' * 40}</html>".encode(), payload_digest(b""), None, False) for i in range(400)]
    out = io.BytesIO()
    write_archive(out, records)
    data = out.getvalue()
    assert data[:4] == bytes.fromhex("5d2a4d18") and len(list(read_archive(io.BytesIO(data)))) == 400
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + int.from_bytes(data[4:8], "little")])
    assert zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[8 + len(dictionary.as_bytes()) :]) == records[0]
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(b"\0" * 8)))
