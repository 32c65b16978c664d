"""SimHash fingerprints, and their links found through vantage-point trees.

A small tree of vantage points, fitted on a bounded sample of the fingerprints, cuts Hamming space
into shards by bands of distance. A fingerprint lives in one shard; by the triangle bound only shards
whose bands lie within the radius of its own distances can hold a link of it, and it visits those
(of two shards the later one only, so each pair meets once). In a shard the tree goes on in memory
until blocks are small enough to compare every pair exactly.

Equal fingerprints are one node from the start. A shard that the tree leaves too large is cut by hash,
and its visitors come in slices: a task compares one part of a shard's own fingerprints with one slice
of visitors, both of bounded size however many there are. It returns a forest of links, at most one a
node, never the pairs: connectivity is whole, and thousands of near copies give thousands of rows.

Bands of Hamming distance prune little at 4 of 64 bits (distances of unlike texts lie close together), so
what a fingerprint visits grows with the number of shards and pairs compared with a power of about 1.7 of
the fingerprints. Memory of a task does not grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Union, as_bytes, bounded_batches, columns_of, fresh, mix64, parallelism, remove, stage
from .components import connected_components

#: Fingerprints that the top of the tree is fitted on: one of so many, at least and at most.
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST = 100, 4096, 262_144
#: Own fingerprints of a task, and visitors that it compares them with, aimed at.
SHARD_POINTS, SLICE_POINTS = 60_000, 60_000
#: Slices of a shard's visitors at least, so that few shards spread over executors too. Pairs compared don't depend on it.
LEAST_SLICES = 8
#: Pairs that one block compares at once.
BLOCK_PAIRS = 1 << 20


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Bits set in over half of the XXH64 of all shingles of lower-cased words; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    hashes = np.array([xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """documents(doc_id, text, ...) -> doc_id, text_hash, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in as_bytes(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    return bounded_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _distance(points: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ v).astype(np.int16)


def _bands(distance: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Bands [lo, hi] that hold all distances, outer ones wider so that none is nearly empty."""
    lo, hi = int(distance.min()), int(distance.max())
    inner_lo, inner_hi = (int(x) for x in np.quantile(distance, [0.1, 0.9]))
    cuts = list(range(inner_lo, inner_hi + 1, width))
    edges = [lo, *[c for c in cuts if lo < c <= hi], hi + 1]
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]


def build_top(sample: np.ndarray, total: int, shard_points: int, width: int = 4) -> list:
    """Nested nodes [vantage point, [[lo, hi, child], ...]]; a leaf is its shard's number. Outermost bands are open."""
    count = 0

    def node(points: np.ndarray, depth: int):
        nonlocal count
        if len(points) * total <= shard_points * len(sample) or len(points) < 64 or depth > 12:
            count += 1
            return count - 1
        v = points[len(points) // 2]
        d = _distance(points, v)
        bands = _bands(d, width)
        if len(bands) < 2:
            count += 1
            return count - 1
        ends = [(-1 if k == 0 else lo, 99 if k == len(bands) - 1 else hi) for k, (lo, hi) in enumerate(bands)]
        return [int(v), [[lo, hi, node(points[(d >= lo) & (d <= hi)], depth + 1)] for lo, hi in ends]]

    return node(sample, 0) if len(sample) else 0


def route(tree, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point's number, shard, whether it lives there) for its shard and all later ones within the radius."""
    who, where, home = [], [], []

    def walk(node, at: np.ndarray, lives: np.ndarray) -> None:
        if not len(at):
            return
        if not isinstance(node, list):
            who.append(at)
            where.append(np.full(len(at), node))
            home.append(lives)
            return
        d = _distance(points[at], np.uint64(node[0]))
        for lo, hi, child in node[1]:
            near = (d >= lo - radius) & (d <= hi + radius)
            walk(child, at[near], lives[near] & (d[near] >= lo) & (d[near] <= hi))

    walk(tree, np.arange(len(points)), np.ones(len(points), bool))
    who, where, home = (np.concatenate(x) if x else np.zeros(0, int) for x in (who, where, home))
    own = np.zeros(len(points), np.int64)
    own[who[home.astype(bool)]] = where[home.astype(bool)]
    keep = where >= own[who]
    return who[keep], where[keep], home[keep].astype(bool)


def link_forest(own: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between own points and visitors as (point, another of its component)."""
    points = np.concatenate((own, visitors))
    union = Union(len(points))

    def compare(p: np.ndarray, q: np.ndarray) -> None:
        step = max(1, BLOCK_PAIRS // max(1, len(q)))
        for k in range(0, len(p), step):
            rows = p[k : k + step]
            i, j = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[q][None, :]) <= radius)
            a, b = rows[i], q[j]
            differ = union.label[a] != union.label[b]
            union.link(a[differ], b[differ])

    def node(p: np.ndarray, q: np.ndarray, depth: int) -> None:
        if not len(p) or not len(q):
            return
        if len(p) * len(q) <= BLOCK_PAIRS or len(p) < 64 or depth > 40:
            return compare(p, q)
        v = points[p[(depth * 7919 + len(p) // 3) % len(p)]]
        dp, dq = _distance(points[p], v), _distance(points[q], v)
        bands = _bands(dp, 3)
        if len(bands) < 2 or len(bands) == 2 and min(((dp >= lo) & (dp <= hi)).sum() for lo, hi in bands) * 50 < len(p):
            return compare(p, q)
        for lo, hi in bands:
            node(p[(dp >= lo) & (dp <= hi)], q[(dq >= lo - radius) & (dq <= hi + radius)], depth + 1)

    node(np.arange(len(own)), len(own) + np.arange(len(visitors)), 0)
    other = points[union.label]
    linked = other != points
    return points[linked], other[linked]


def plan_shards(sample: np.ndarray, total: int, radius: int) -> tuple[list, np.ndarray, np.ndarray]:
    """The tree; for each shard the parts that its own points are cut into, and the slices its visitors come in, as the sample says."""
    tree = build_top(sample, total, SHARD_POINTS)
    _, where, home = route(tree, sample, radius)
    shards = 1 + int(where.max(initial=0))
    scale = total / max(1, len(sample))
    own, all_ = np.bincount(where[home], minlength=shards) * scale, np.bincount(where, minlength=shards) * scale
    return tree, np.maximum(1, np.ceil(own / (2 * SHARD_POINTS))).astype(np.int64), np.maximum(LEAST_SLICES, np.ceil(all_ / SLICE_POINTS)).astype(np.int64)


def deal(tree: list, parts: np.ndarray, slices: np.ndarray, points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(shard, part, slice, number of the point, whether it is own there) of all tasks that the points belong to."""
    who, where, home = route(tree, points, radius)
    hashed = mix64(points)
    part = lambda w, s: ((hashed[w] >> np.uint64(20)) % parts[s].astype(np.uint64)).astype(np.int64)
    slice_ = lambda w, s: ((hashed[w] >> np.uint64(40)) % slices[s].astype(np.uint64)).astype(np.int64)

    def spread(n: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = np.repeat(np.arange(len(w)), n[s])
        return w[each], s[each], np.arange(len(each)) - np.repeat(np.cumsum(n[s]) - n[s], n[s])

    w, s, p = spread(parts, who, where)
    yield s, p, slice_(w, s), w, False
    w, s, c = spread(slices, who[home], where[home])
    yield s, part(w, s), c, w, True


def fingerprint_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """nodes(fp), distinct -> edges(a, b) that connect what pairs of at most `radius` differing bits connect."""
    total = nodes.count()
    want = min(SAMPLE_MOST, max(SAMPLE_LEAST, total // SAMPLE_SHARE))
    picked = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, total // want))) == 0)
    tree, parts, slices = plan_shards(np.sort(picked.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)), total, radius)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(points), 20_000):
                some = points[k : k + 20_000]
                for shard, part, slice_, who, own in deal(tree, parts, slices, some, radius):
                    yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (shard, part, slice_)), pa.array(some[who].view(np.int64)), pa.array(np.full(len(who), own))], ["shard", "part", "slice", "fp", "own"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        points, own = pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy()
        a, b = link_forest(points[own], points[~own], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = nodes.repartition(parallelism(nodes.sparkSession)).mapInArrow(send, "shard int, part int, slice int, fp long, own boolean")
    return sent.groupBy("shard", "part", "slice").applyInPandas(join, "a long, b long")


def simhash_near_dedup(documents: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """documents(doc_id, text, ...) -> doc_id, text_hash, fp, fingerprint, component_id, component.

    Documents link if their fingerprints differ in at most `radius` bits; component_id is the smallest
    doc_id that links lead to, itself included, and `component` the group's number for grouping rows.
    One row per input row. Null and blank texts have fingerprint zero and link like any other. A null
    doc_id counts for a link, but names a component only where no other is in it (then null). Repeated
    rows have equal fingerprints and so one component. Other columns are ignored, whatever their names.
    """
    rows, _ = stage(fingerprints(documents, shingle), "fingerprints")
    nodes, nodes_at = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    found, found_at = connected_components(fingerprint_links(nodes.select("fp"), radius))
    member = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    named, named_at = stage(
        member.select("fp", "component").join(member.groupBy("component").agg(F.min("low").alias("component_id")), "component"), "named"
    )
    remove(documents.sparkSession, nodes_at, found_at)
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component")


def keep_one(documents: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One document of each group, with all its columns: that of the smallest doc_id (then text hash; nulls last).

    Of rows that repeat that doc_id and text one stays. Null and blank texts are a group like any other.
    An empty table gives no row. Columns of any names pass through.
    """
    groups = simhash_near_dedup(documents, shingle, radius)
    each = groups.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "copies"))
    id_, hash_, copies, key = fresh(documents, "kept_id", "kept_hash", "copies", "key")
    kept, _ = stage(each.groupBy("component").agg(first.alias("k")).select(F.col("k.doc_id").alias(id_), F.col("k.text_hash").alias(hash_), F.col("k.copies").alias(copies)), "kept")
    keyed = documents.withColumn(key, F.xxhash64("text"))
    out = keyed.join(kept, keyed["doc_id"].cast("long").eqNullSafe(kept[id_]) & (keyed[key] == kept[hash_]))
    if kept.where(F.col(copies) > 1).isEmpty():
        return out.select(*columns_of(documents))
    once = out.where(F.col(copies) > 1).dropDuplicates([id_, hash_])
    return out.where(F.col(copies) == 1).unionByName(once).select(*columns_of(documents))
