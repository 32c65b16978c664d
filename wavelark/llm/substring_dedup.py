"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of half a window; these blocks are the index, and
every rolling window of a block's length probes it. A repeat of a whole window, at whatever shift,
always holds one whole indexed block of its earlier copy, so a probe with no answer rules repeats
out. Probes that hit are extended to the windows around them, whose full hashes decide which copy
comes first; runs of repeated windows are the maximal repeats, and their words go.

The corpus lies in a bucketed table in document order: parts, as many as a bucketed table may have at
most, and in these small chunks, so that what a task holds is a chunk however large the corpus. Three
passes read it; between them only hash buckets travel: for each chunk and bucket one packed, sorted list
in which a hash occurs once however often the chunk has it, and one bit a hash on the way back. A passage
that a third of all documents share is therefore one entry a chunk, and no pair of its copies is formed.
Buckets grow in number with the corpus, so that none holds more than a bounded number of hashes; lists
get shorter for it, and beyond some terabytes what travels tends to a row for every few hashes.

A probe that finds a block by 64 bits only makes a candidate. Whether two windows are equal is decided
by 128 bits: two hashes of the word sequence, under multipliers of their own.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_starts, new_path, pack, pack_sorted, parallelism, released_shuffles, remove, stage, text_or_empty, unpack, unpack_sorted, window_hashes

#: Hashes in a bucket, aimed at; bytes of text for which about one hash is sent; chunks of a part, at most.
BUCKET_HASHES, BYTES_PER_HASH, PART_CHUNKS = 4_000_000, 6, 1 << 20
_SENT = "bucket int, chunk long, keys binary, more binary, other binary"
_MARKS = "chunk long, kind int, bucket int, bits binary"
_ONE_KEY = "spark.sql.requireAllClusterKeysForCoPartition"


class _Chunk:
    """Words, rolling block hashes and window hashes of one chunk's documents."""

    def __init__(self, texts: list[str], window: int, log_buckets: int):
        from xxhash import xxh3_64_intdigest

        self.window, self.block, self.log_buckets = window, window // 2, log_buckets
        self.words = [t.encode().split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)))
        n = int(self.begin[-1])
        self.hashes = np.fromiter((h for w in self.words for h in map(xxh3_64_intdigest, w)), np.uint64, n)
        self.end_of = np.repeat(self.begin[1:], self.sizes)
        self.start_of = np.repeat(self.begin[:-1], self.sizes)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.log_buckets)).astype(np.int64)

    def probes(self):
        """Distinct keys of the rolling blocks, ascending; for each whether a block of the index has it and whether it occurs again here; and for each position its key."""
        h = window_hashes(self.hashes, self.block, 10)
        at = np.flatnonzero(np.arange(len(h)) + self.block <= self.end_of[: len(h)])
        key = h[at] >> np.uint64(32 - self.log_buckets)
        order = np.argsort(key, kind="stable")
        first = group_starts(key[order])
        which = np.empty(len(at), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(at)))
        indexed = ((at - self.start_of[at]) % self.block == 0)[order]
        is_indexed = np.logical_or.reduceat(indexed, first) if len(first) else np.zeros(0, bool)
        again = np.diff(first, append=len(at)) > 1
        keys = key[order][first]
        return keys, is_indexed, again, at, which

    def bounds(self, bucket: np.ndarray):
        """(bucket, from, to) of the buckets that ascending keys fall in."""
        first = group_starts(bucket)
        return zip(bucket[first].tolist(), first.tolist(), np.append(first, len(bucket))[1:].tolist(), strict=True)

    def candidates(self, hit: np.ndarray, at: np.ndarray, which: np.ndarray):
        """Starts of the whole windows that hold a hit; their distinct hashes, ascending, and the other 64 bits of each; each one's first start here; for each start its hash's number."""
        n = len(self.hashes)
        count = np.zeros(n + self.window + 1, np.int64)
        count[at[hit[which]] + 1] = 1
        count = np.cumsum(count)
        start = np.arange(max(0, n - self.window + 1))
        start = start[start + self.window <= self.end_of[start]]
        start = start[count[start + self.block + 1] > count[start]]
        h = window_hashes(self.hashes, self.window, 20)[start]
        g = window_hashes(self.hashes, self.window, 21, 0xD1342543DE82EF95)[start]
        order = np.lexsort((g, h))
        first = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])))) if len(h) else np.zeros(0, np.int64)
        number = np.empty(len(start), np.int64)
        number[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(start)))
        lowest = np.minimum.reduceat(start[order], first) if len(first) else start
        return start, h[order][first], g[order][first], lowest, number


def _send_probes(pdf: pd.DataFrame, window: int, log_buckets: int) -> pd.DataFrame:
    c = _Chunk(_ordered(pdf)["text"].tolist(), window, log_buckets)
    keys, indexed, again, _, _ = c.probes()
    chunk = int(pdf["chunk"].iloc[0])
    rows = []
    for b, i, j in c.bounds((keys >> np.uint64(32)).astype(np.int64)):
        rows.append((b, chunk, pack_sorted((keys[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), np.packbits(np.concatenate((indexed[i:j], again[i:j]))).tobytes(), None))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "more", "other"])


def _answer_probes(pdf: pd.DataFrame) -> pd.DataFrame:
    """A key hits if an indexed block has it and it stands at two places or more."""
    keys, indexed, again = [], [], []
    for k, m in zip(pdf["keys"], pdf["more"], strict=True):
        k = unpack_sorted(k, np.uint32)
        flags = np.unpackbits(np.frombuffer(m, np.uint8), count=2 * len(k)).astype(bool)
        keys.append(k)
        indexed.append(flags[: len(k)])
        again.append(flags[len(k) :])
    sizes = [len(k) for k in keys]
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    first = group_starts(key[order])
    size = np.diff(first, append=len(key))
    good = np.logical_or.reduceat(np.concatenate(indexed)[order], first) & ((size > 1) | np.logical_or.reduceat(np.concatenate(again)[order], first))
    hit = np.empty(len(key), bool)
    hit[order] = np.repeat(good, size)
    return pd.DataFrame({"chunk": pdf["chunk"], "kind": 1, "bucket": pdf["bucket"], "bits": [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum(sizes)[:-1])]})


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows by document, nulls first, then by text hash: the order in which copies count as earlier."""
    return pdf.sort_values(["no_id", "doc_id", "text_hash"], kind="stable", ascending=[False, True, True])


def _marked(marks: pd.DataFrame, kind: int, buckets, n: int) -> np.ndarray:
    """Bits that came back, in the order in which the keys were sent."""
    bits = dict(zip(*(marks.loc[marks["kind"] == kind, x] for x in ("bucket", "bits")), strict=True))
    out = np.zeros(n, bool)
    for b, i, j in buckets:
        out[i:j] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=j - i).astype(bool)
    return out


def _extended(pdf: pd.DataFrame, marks: pd.DataFrame, window: int, log_buckets: int):
    c = _Chunk(pdf["text"].tolist(), window, log_buckets)
    keys, _, _, at, which = c.probes()
    hit = _marked(marks, 1, c.bounds((keys >> np.uint64(32)).astype(np.int64)), len(keys))
    return c, c.candidates(hit, at, which)


def _send_windows(pdf: pd.DataFrame, marks: pd.DataFrame, window: int, log_buckets: int) -> pd.DataFrame:
    rows = []
    if len(pdf):
        c, (_, h, other, first, _) = _extended(_ordered(pdf), marks, window, log_buckets)
        chunk = int(pdf["chunk"].iloc[0])
        for b, i, j in c.bounds(c._bucket(h)):
            rows.append((b, chunk, pack_sorted(h[i:j]), pack(first[i:j].astype(np.uint32)), other[i:j].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "more", "other"])


def _answer_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bit a window hash: whether its first start in that chunk is the first of all."""
    keys = [unpack_sorted(k, np.uint64) for k in pdf["keys"]]
    sizes = [len(k) for k in keys]
    place = np.concatenate([unpack(m, np.uint32) for m in pdf["more"]])
    key, other, chunk = np.concatenate(keys), np.frombuffer(b"".join(pdf["other"]), np.uint64), np.repeat(pdf["chunk"].to_numpy(), sizes)
    order = np.lexsort((place, chunk, other, key))
    first = np.zeros(len(key), bool)
    first[order[np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1])))]] = True
    return pd.DataFrame({"chunk": pdf["chunk"], "kind": 2, "bucket": pdf["bucket"], "bits": [np.packbits(x).tobytes() for x in np.split(first, np.cumsum(sizes)[:-1])]})


def _cut(pdf: pd.DataFrame, marks: pd.DataFrame, window: int, log_buckets: int, with_text: bool) -> pd.DataFrame:
    if not len(pdf):
        return pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "n_words": pd.Series(dtype="int64"), "n_removed": pd.Series(dtype="int64"), "kept_sha256": pd.Series(dtype="object"), "removed_spans": pd.Series(dtype="object"), "kept_text": pd.Series(dtype="object")})
    pdf = _ordered(pdf)
    c, (start, h, _, first, number) = _extended(pdf, marks, window, log_buckets)
    is_first = _marked(marks, 2, c.bounds(c._bucket(h)), len(h))
    repeated = start[~(is_first[number] & (first[number] == start))]
    step = np.zeros(len(c.hashes) + 1, np.int64)
    step[repeated] += 1
    step[repeated + window] -= 1
    gone = np.cumsum(step)[:-1] > 0
    edge = np.diff(np.concatenate((gone, [False])).astype(np.int8), prepend=np.int8(0))
    edge[c.begin[:-1][c.sizes > 0]] = gone[c.begin[:-1][c.sizes > 0]]  # spans end with their document
    n_removed, shas, spans, kept = [], [], [], []
    for k, words in enumerate(c.words):
        i, j = int(c.begin[k]), int(c.begin[k + 1])
        out = gone[i:j]
        flips = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
        n_removed.append(int(out.sum()))
        left = [w for w, x in zip(words, out.tolist(), strict=True) if not x] if len(flips) else words
        joined = b" ".join(left)
        shas.append(hashlib.sha256(joined).hexdigest())
        spans.append(flips.reshape(-1, 2).tolist())
        kept.append(joined.decode() if with_text else None)
    return pd.DataFrame({"doc_id": pdf["doc_id"].mask(pdf["no_id"]).astype("Int64").tolist(), "n_words": c.sizes, "n_removed": n_removed, "kept_sha256": shas, "removed_spans": spans, "kept_text": kept})


def substring_dedup(documents: DataFrame, window: int = 20, chunk_bytes: int = 4 << 20, with_text: bool = False) -> DataFrame:
    """documents(doc_id, text, ...) -> doc_id, n_words, n_removed, kept_sha256, removed_spans, kept_text.

    Words covered by a window of `window` words that also starts earlier (in a smaller doc_id, or
    earlier in the same document) are removed; removed_spans lists them as [start, end) word numbers,
    kept_text (with_text only, else null) is the rest joined by spaces. One row per input row.

    Null text has no words. A null doc_id precedes all others; rows of one doc_id count in the order
    of their text hashes, so of repeated rows the first keeps its words and the others lose them. An empty
    table gives no row. Other columns are ignored, whatever their names. Documents shorter than a window
    keep all. An even window of 4 words or more is asked for. Equality of windows is that of 128 bits of hash.
    """
    if window < 4 or window % 2:
        raise ValueError("window must be an even number of 4 words or more")
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks = max(1, -(-size // chunk_bytes), min(parallelism(spark), 8))
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    parts = min(chunks, most)
    chunk_rows = max(1, -(-n // chunks)) if parts < chunks else max(1, n)
    log_buckets = min(30, max(4, (4 * parallelism(spark) - 1).bit_length(), (size // (BYTES_PER_HASH * BUCKET_HASHES)).bit_length()))
    table, where = f"wavelark_{uuid.uuid4().hex}", new_path(spark, "chunks")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    ranged = docs.withColumns({"text_hash": F.xxhash64("text"), "no_id": F.col("doc_id").isNull()}).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Rows are numbered within their partition: as many as a chunk has make the next chunk of the part.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    chunk = F.spark_partition_id().cast("long") * PART_CHUNKS + F.least(F.floor(row / chunk_rows), F.lit(PART_CHUNKS - 1))
    paths, one_key = [where], spark.conf.get(_ONE_KEY)
    key = ["part", "chunk"]
    try:
        with released_shuffles(spark):
            ranged.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "no_id", "text_hash", "text", F.spark_partition_id().alias("part"), chunk.alias("chunk")).write.bucketBy(min(most, max(parts, parallelism(spark))), "part").option("compression", "zstd").option("path", where).saveAsTable(table)
        # Buckets are by part: marks go to the texts, not the other way, if that one key is enough.
        spark.conf.set(_ONE_KEY, "false")
        rows = spark.table(table)
        marked = lambda marks: marks.withColumn("part", F.floor(F.col("chunk") / PART_CHUNKS).cast("int"))
        hits, hits_at = stage(rows.groupBy(*key).applyInPandas(lambda pdf: _send_probes(pdf, window, log_buckets), _SENT).groupBy("bucket").applyInPandas(_answer_probes, _MARKS), "hits")
        paths.append(hits_at)
        firsts, firsts_at = stage(
            rows.groupBy(*key).cogroup(marked(hits).groupBy(*key)).applyInPandas(lambda a, b: _send_windows(a, b, window, log_buckets), _SENT).groupBy("bucket").applyInPandas(_answer_windows, _MARKS),
            "firsts",
        )
        paths.append(firsts_at)
        result, _ = stage(
            rows.groupBy(*key).cogroup(marked(hits.unionByName(firsts)).groupBy(*key)).applyInPandas(
                lambda a, b: _cut(a, b, window, log_buckets, with_text),
                "doc_id long, n_words long, n_removed long, kept_sha256 string, removed_spans array<array<long>>, kept_text string",
            ),
            "substring",
        )
    finally:
        spark.conf.set(_ONE_KEY, one_key)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(spark, *paths)
    return result
