"""Quality by importance resampling.

Two generative models over hashed word unigrams and bigrams: one of the target (labelled documents of
good quality), one of the raw corpus (all documents). A document's log weight is the sum over its
n-grams of the log ratio of their probabilities; adding Gumbel noise and taking the k largest samples
without replacement in proportion to the weights.

Both models are a fixed number of buckets, summed in each task before anything moves. The k-th largest
key is found by repeated histograms of fixed size; no global sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, mix64, stage

#: Buckets of the models, slices in which tasks' counts meet, and labelled rows that are used at most.
BUCKETS, SLICES, MAX_LABELS = 1 << 14, 16, 20_000


def ngram_buckets(text: bytes | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words and pairs of neighbouring words of a lower-cased text."""
    from xxhash import xxh3_64_intdigest

    words = (text or b"").lower().split()
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate((h, pairs)) % np.uint64(buckets)).astype(np.int64)


def fit(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """(log ratio of each bucket, share of good quality among the labelled rows used).

    At most MAX_LABELS labelled rows are used, by hash of doc_id; counts of the raw model cover all
    documents. Labels without a quality or doc_id don't count. Without a good one all ratios are 0.
    """
    used = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(MAX_LABELS).collect()
    good = frozenset(r.doc_id for r in used if r.quality == 1)
    share = sum(r.quality == 1 for r in used) / len(used) if used else 1.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                here = np.bincount(ngram_buckets(text, buckets), minlength=buckets)
                sums[0] += here
                if doc in good:
                    sums[1] += here
        for k, part in enumerate(np.split(sums, SLICES, axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64) for x in pdf["counts"]], axis=0)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [total.tobytes()]})

    counted = bounded_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    if not good or not counted:
        return np.zeros(buckets), share
    raw, target = np.concatenate([np.frombuffer(r.counts, np.int64).reshape(2, -1) for r in sorted(counted)], axis=1)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets)), share


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The largest t such that at least k values are >= t, from histograms of the range that holds it; -inf if k values aren't there."""
    r = keys.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if k <= 0:
        return float("inf")
    if k >= r["n"]:
        return float("-inf")
    lo, hi, above = r["lo"], r["hi"], 0
    while True:
        inside = keys.where((F.col(column) >= lo) & (F.col(column) <= hi))
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return lo
        bin_ = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
        for b in sorted(inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda x: -x["bin"]):
            if above + b["n"] >= k:
                break
            above += b["n"]
        if b["n"] <= 1000:
            return sorted((x[0] for x in keys.where((F.col(column) >= b["lo"]) & (F.col(column) <= b["hi"])).select(column).collect()), reverse=True)[k - above - 1]
        lo, hi = b["lo"], b["hi"]
        if lo == hi:
            return lo


def importance_resample(documents: DataFrame, labels: DataFrame, keep_share: float | None = None, seed: int = 11, buckets: int = BUCKETS) -> DataFrame:
    """documents(doc_id, text, ...), labels(doc_id, quality, ...) -> doc_id, n_ngrams, log_weight, key, selected; one row per input row.

    keep_share of all rows are selected, rounded; None: the share of good quality among the labels. Null
    and blank texts have no n-grams and log weight 0. Noise depends on doc_id and text, so reruns agree;
    repeated rows have one key, and are selected together (then beyond the share). An empty table gives
    no row. Other columns are ignored.
    """
    ratio, share = fit(documents, labels, buckets)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [ngram_buckets(t, buckets) for t in as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(g) for g in grams], pa.int64()), pa.array([float(ratio[g].sum()) for g in grams], pa.float64())], ["doc_id", "text_hash", "n_ngrams", "log_weight"])

    rows = bounded_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(score, "doc_id long, text_hash long, n_ngrams long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(2.0**53)
    keyed, _ = stage(rows.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))).drop("text_hash"), "scores")
    k = round(keyed.count() * (share if keep_share is None else keep_share))
    return keyed.withColumn("selected", F.col("key") >= F.lit(kth_largest(keyed, "key", k)))
