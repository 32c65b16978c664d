import hashlib

import pytest
from pyspark.sql import types as T

from wavelark.llm import substring_dedup as substring_dedup_module
from wavelark.llm.substring_dedup import substring_dedup

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("chunk", T.StringType()), T.StructField("bucket", T.LongType())])


def brute(rows, window=20):
    """All windows in order; a word goes if a window over it was seen before."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone.update(range(s, s + window))
            seen.add(w)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA).repartition(3)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, **options).collect()), key=str)


def test_against_brute_force_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, chunk_bytes=40_000).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
def test_shifts_ties_nulls_and_long_texts(spark, chunk_bytes):
    p = " ".join(f"p{i}" for i in range(45))
    q = " ".join(f"q{i}" for i in range(20))
    rows = [(5, f"a b c {p} d"), (2, f"x {p}"), (9, p + " " + p), (7, None), (8, ""), (11, " \t\n"), (12, q), (13, " ".join(q.split()[:19])), (14, f"z\n{q}\x0bz"), (None, f"n {q}")]
    rows += [(20, "w " * 500), (21, " ".join(f"{q} {i}" for i in range(40))), (22, "   é " * 30)]
    assert run(spark, rows, chunk_bytes=chunk_bytes) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(str(i) for i in range(30))
    got = run(spark, [(1, text)] * 3)
    assert sorted(r[2] for r in got) == [0, 30, 30]
    assert run(spark, []) == []


def test_spans_and_text(spark):
    text = " ".join(str(i) for i in range(30))
    df = spark.createDataFrame([(1, text), (2, "a " + text + " b")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup(df, with_text=True).collect()}
    assert got[2].removed_spans == [[1, 31]] and got[2].kept_text == "a b" and got[1].kept_text == text
    with pytest.raises(ValueError):
        substring_dedup(df, window=5)


def test_more_chunks_than_buckets(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(substring_dedup_module, "BUCKET_HASHES", 50)
    want = sorted(tuple(r)[:4] for r in substring_dedup(df).collect())
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "8")
    try:
        got = substring_dedup(df, chunk_bytes=8000)
        assert sorted(tuple(r)[:4] for r in got.collect()) == want
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
