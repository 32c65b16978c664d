import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from wavelark.llm.packing import BestFit, best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("piece", T.StringType())])


def check(df, capacity=4096):
    tok, want = Tokenizer.from_file(PATH), []
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((r.doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    got = best_fit_packing(df, PATH, capacity).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in got)


def test_documents_pack_tightly(spark):
    bins, tokens = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert bins <= 1.03 * tokens / 4096 + 1


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "<|endoftext|> a<|startoftext|>b", "x"), (3, "word " * 30000, "x"), (4, "Ǆ é ́x y   it's 123", "x")]
    check(spark.createDataFrame(rows, SCHEMA), 64)
    assert best_fit_packing(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_fullest_bin_closes_first():
    bins = BestFit(10, 2)
    assert [bins.place(x) for x in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # the bin of 2 free closes
    assert bins.place(3) == (1, 7) and bins.place(2) == (0, 6) and bins.place(10) == (3, 0) and bins.place(2) == (0, 8)


def test_many_partitions_pack_as_tightly(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(211)
    got = best_fit_packing(df, PATH)
    bins, tokens = got.select("sequence_id").distinct().count(), got.groupBy().sum("length").first()[0]
    assert bins <= 1.03 * tokens / 4096 + 1
