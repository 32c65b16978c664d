import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.llm.quality_classifier import importance_resample, kth_largest, ngram_buckets

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("selected", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType())])


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    rows = [r for r in importance_resample(docs, train).collect() if r.doc_id in held]
    good, bad = [r.log_weight for r in rows if held[r.doc_id] == 1], [r.log_weight for r in rows if held[r.doc_id] == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for g in good[:400]] for b in bad])
    assert auc > 0.9
    kept = {r.doc_id: r.selected for r in rows}
    assert np.mean([kept[d] for d in held if held[d] == 1]) > 0.9 and np.mean([kept[d] for d in held if held[d] == 0]) < 0.3


def test_weights_against_plain_counts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, target = np.ones(1 << 14), np.ones(1 << 14)
    for d, t in texts.items():
        for g in ngram_buckets(t.encode()):
            raw[g] += 1
            target[g] += d in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    rows = importance_resample(docs, labels, keep_share=0.25).collect()
    assert all(abs(r.log_weight - sum(ratio[g] for g in ngram_buckets(texts[r.doc_id].encode()))) < 1e-6 for r in rows)
    top = sorted(rows, key=lambda r: -r.key)[: round(0.25 * len(rows))]
    assert {r.doc_id for r in top} == {r.doc_id for r in rows if r.selected}


def test_kth_largest(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 2500, 7.0).otherwise(F.sqrt("id")).alias("x"))
    values = sorted((r.x for r in df.collect()), reverse=True)
    assert all(kth_largest(df, "x", k, bins=4) == values[k - 1] for k in (1, 3, 2500, 2501, 4999))
    assert kth_largest(df, "x", 5000) == float("-inf") and kth_largest(df, "x", 0) == float("inf")


def test_edges(spark):
    rows = [(1, None, "", 0), (2, "", "", 0), (3, "one", "", 0), (3, "one", "", 0), (None, "É é " * 50000, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = importance_resample(docs, spark.createDataFrame([(3, 1), (None, 1), (2, None), (1, 0)], LABELS)).collect()
    assert sorted(r.n_ngrams for r in got) == [0, 0, 1, 1, 199999] and len({r.key for r in got if r.doc_id == 3}) == 1
    assert importance_resample(docs, spark.createDataFrame([], LABELS)).where("selected").count() == 5
    assert importance_resample(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(3, 1)], LABELS)).collect() == []
