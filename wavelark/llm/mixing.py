"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Documents are cut into blocks, each source's blocks are put in a permutation by hash, and the source's
quota is a whole number of them: all blocks as often as the target holds the source's size, then as many
of one more permutation as reach the target. The quotas of all sources are split between two halves of
the output shards by one multivariate-hypergeometric draw, each half again, down to single shards; so
every shard gets its share of every source as a random deal would give it, and the quotas are met
exactly. A shard takes disjoint stretches of the permutations, and shuffles them; the mix is what the
shards take. Draws are exact at any size. The tree's nodes seed themselves, so that tasks split the
lower ones; stretches meet blocks in a join by cells, never through a list of all shards.

Ranks in a permutation come in two levels: buckets of the hash are counted and summed per source, and
blocks are ranked inside a bucket only. A source with a third of all rows has more buckets, not larger
ones. What reaches the driver is one row per source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, columns_of, fresh, remove, stage

#: The weights of sources in their order, repeating; the mix's share of all words; the most of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Blocks in a bucket of a permutation, words in an output shard, and sources that the driver may hold.
BUCKET_BLOCKS, SHARD_WORDS, MAX_SOURCES = 20_000, 4_000_000, 1_000_000
#: Nodes of the splitting tree that the driver splits down to, and the counts from which on NumPy's sampler ends.
TOP_NODES, NUMPY_MOST = 256, 1_000_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def count_words(column: pa.Array) -> np.ndarray:
    """Words of each text, counted on the UTF-8 bytes; null: 0."""
    texts = as_bytes(column)
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    if not len(sizes):
        return sizes
    space = _SPACE[np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)]
    ends = space.copy()
    ends[1:] &= ~space[:-1]
    ends[0] = False
    return np.add.reduceat(ends, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words that the mix is to take of each source; sources by code point, null last."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    out, left, rest = {}, set(order), share * sum(sizes.values())
    while left:
        total = sum(weight[s] for s in order if s in left)
        over = [s for s in order if s in left and rest * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / total for s in left}
        for s in over:
            out[s] = float(most * sizes[s])
            left.remove(s)
        rest = share * sum(sizes.values()) - sum(out.values())
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` from good + bad are good; beyond NumPy's bound by inversion of the distribution around its mode."""
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad
    least, most = max(0, draws - bad), min(draws, good)
    mode = min(most, max(least, (draws + 1) * (good + 1) // (n + 2)))
    reach = 64 + int(14 * math.sqrt(draws * (good / n) * (bad / n) * ((n - draws) / (n - 1))))
    low, high = max(least, mode - reach), min(most, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    chance = np.concatenate(([0.0], np.cumsum(np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1))))
    up_to = np.cumsum(np.exp(chance - chance.max()))
    return low + int(np.searchsorted(up_to, rng.random() * up_to[-1]))


def draw(rng: np.random.Generator, have: np.ndarray, part: int) -> np.ndarray:
    """A multivariate-hypergeometric draw of `part` from the counts, at any size: one count after another."""
    if have.sum() < NUMPY_MOST:
        return rng.multivariate_hypergeometric(have, part, method="marginals")
    out, rest = np.zeros_like(have), int(have.sum())
    for k, n in enumerate(have.tolist()):
        rest -= n
        out[k] = hypergeometric(rng, n, rest, part) if part else 0
        part -= int(out[k])
    return out


def split(lo: int, hi: int, have: np.ndarray, seed: int) -> np.ndarray:
    """What shards [lo, mid) get of a node's counts; the same wherever it is drawn."""
    mid, total = (lo + hi) // 2, int(have.sum())
    return draw(np.random.default_rng([seed, lo, hi]), have, total * (mid - lo) // (hi - lo))


def splitting_tree(lo: int, hi: int, sources: np.ndarray, have: np.ndarray, ahead: np.ndarray, seed: int, least: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The nodes of at most `least` shards below a node, as (lo, hi, sources, have, ahead): blocks they get of each source, and how many of it lie before."""
    if hi - lo <= least:
        yield lo, hi, sources, have, ahead
        return
    left = split(lo, hi, have, seed)
    for a, b, n, before in ((lo, (lo + hi) // 2, left, ahead), ((lo + hi) // 2, hi, have - left, ahead + left)):
        some = n > 0
        if some.any():
            yield from splitting_tree(a, b, sources[some], n[some], before[some], seed, least)


def shard_cuts(spark: SparkSession, quotas: np.ndarray, shards: int, seed: int) -> DataFrame:
    """number, shard, from, to: the stretch [from, to) of a source's drawn blocks that a shard takes.

    The driver splits the top of the tree; tasks split the nodes below, which need nothing but themselves.
    """
    some = np.flatnonzero(quotas)
    top = splitting_tree(0, shards, some, quotas[some].astype(np.int64), np.zeros(len(some), np.int64), seed, -(-shards // TOP_NODES)) if len(some) else []
    rows = [(lo, hi, s.tolist(), n.tolist(), a.tolist()) for lo, hi, s, n, a in top]

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                for shard, _, sources, have, ahead in splitting_tree(r.lo, r.hi, np.array(r.sources), np.array(r.have), np.array(r.ahead), seed):
                    yield pd.DataFrame({"number": sources, "shard": shard, "from": ahead, "to": ahead + have})

    nodes = spark.createDataFrame(rows, "lo long, hi long, sources array<int>, have array<long>, ahead array<long>")
    return nodes.repartition(min(max(1, len(rows)), 64)).mapInPandas(below, "number int, shard long, from long, to long")


def _row_keys(documents: DataFrame) -> list[Column]:
    """128 bits of hash over all columns that can be hashed: rows with the same are interchangeable."""
    kinds = dict(zip(documents.columns, (f.dataType.simpleString() for f in documents.schema.fields), strict=True))
    whole = [c for c, k in zip(columns_of(documents), kinds.values(), strict=True) if "map<" not in k and "variant" not in k]
    return [F.xxhash64(*whole), F.xxhash64(F.lit(1), *whole)]


def sized(documents: DataFrame, source_col: str = "source") -> DataFrame:
    """documents -> row (a number of its own), doc_id, text_hash, k1, k2 (of the row as a whole), source, size; written, so numbers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(count_words(b.column(5)))], ["doc_id", "text_hash", "k1", "k2", "source", "size"])

    k1, k2 = _row_keys(documents)
    rows = bounded_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), k1.alias("k1"), k2.alias("k2"), F.col(source_col).cast("string").alias("source"), "text")
    rows = rows.mapInArrow(run, "doc_id long, text_hash long, k1 long, k2 long, source string, size long")
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "sized")[0]


def mix_plan(documents: DataFrame, block_words: int | None = 256, seed: int = 7, source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """documents(doc_id, text, source, ...) -> (documents with size, source_size and target; the blocks taken).

    Taken blocks: row, doc_id, text_hash, block, start and length in words, copy, shard, place (order
    within the shard). block_words None: a block is a whole document. A document's blocks are taken at
    most `most` times. Null text has no words and is never taken; null sources are one source, the last.
    Repeated rows are documents of their own. The hash of (doc_id, text, block) orders a permutation, so
    that reruns, and tables in another order of rows, give the same mix (but for which of several
    identical rows is taken).
    """
    if most != int(most):
        raise ValueError("most must be whole: that many permutations are drawn from")
    spark = documents.sparkSession
    docs = sized(documents, source_col)
    width = F.col("size") if block_words is None else F.lit(block_words)
    cut = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / width))))
    cut = cut.select("row", "doc_id", "text_hash", "k1", "k2", "source", "block", (F.col("block") * width).alias("start"), F.least(width.cast("long"), F.col("size") - F.col("block") * width).alias("length"))
    by_source = docs.groupBy("source").agg(F.sum("size").alias("size")).join(cut.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("blocks")), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "size", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    found = by_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    size = {r.source: r["size"] for r in found}
    goal = targets(size, weights, share, most)
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    whole = {s: min(int(most), int(goal[s] // size[s])) if size[s] else 0 for s in order}
    blocks = {r.source: r.blocks for r in found}
    info = spark.createDataFrame(
        [(k, s, size[s], goal[s], whole[s], goal[s] - whole[s] * size[s], blocks[s], max(1, -(-blocks[s] // BUCKET_BLOCKS))) for k, s in enumerate(order)],
        "number int, source string, source_size long, target double, whole int, extra double, blocks long, buckets long",
    )
    informed = docs.withColumnRenamed("source", "__s").join(info.select("source", "source_size", "target"), F.col("__s").eqNullSafe(F.col("source"))).select("row", "doc_id", "text_hash", "source", "size", "source_size", "target")
    # Level one: buckets of each permutation, with what lies before them.
    number = F.col("number")
    keyed = cut.withColumnRenamed("source", "__s").join(info, F.col("__s").eqNullSafe(F.col("source"))).drop("__s", "source")
    copies = keyed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least(F.col("whole"), F.lit(int(most) - 1)))))
    copies = copies.withColumn("u", F.xxhash64("doc_id", "text_hash", "block", "copy", F.lit(seed))).withColumn("bucket", F.floor(F.shiftrightunsigned("u", 33) * F.col("buckets") / F.lit(2.0**31)).cast("long"))
    placed, placed_at = stage(copies.select("row", "doc_id", "text_hash", "k1", "k2", "block", "start", "length", "number", "copy", "whole", "extra", "blocks", "bucket", "u"), "blocks")
    before = Window.partitionBy("number", "copy").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = placed.groupBy("number", "copy", "bucket").agg(F.count("*").alias("n"), F.sum("length").alias("w")).select("number", "copy", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    # Level two: ranks and words within a bucket; `nth` counts a source's blocks, one permutation after another.
    within = Window.partitionBy("number", "copy", "bucket").orderBy("u", "doc_id", "row", "block")
    ranked = placed.join(ahead, ["number", "copy", "bucket"]).withColumn("rank", F.col("n0") + F.row_number().over(within) - 1).withColumn("before", F.col("w0") + F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    within_target = (F.col("copy") < F.col("whole")) | (F.col("before") + F.col("length") / 2 <= F.col("extra"))
    drawn, drawn_at = stage(ranked.select("row", "doc_id", "text_hash", "k1", "k2", "block", "start", "length", "number", "copy", (F.col("copy") * F.col("blocks") + F.col("rank")).alias("nth"), "u", within_target.alias("wanted")), "drawn")
    # A source's quota in blocks: those up to its target. The tree deals quotas to shards, and a shard takes
    # its own stretch of each source's drawn blocks: what no shard takes is not in the mix.
    count = {r.number: (r.n, r.w) for r in drawn.where("wanted").groupBy("number").agg(F.count("*").alias("n"), F.sum("length").alias("w")).collect()}
    quotas = np.array([count.get(k, (0, 0))[0] for k in range(len(order))], np.int64)
    shards = max(1, -(-sum(w for _, w in count.values()) // SHARD_WORDS))
    # Stretches meet blocks in cells of about a shard's stretch, so that no block is held against all shards.
    cells = spark.createDataFrame([(k, max(1, int(q) // shards)) for k, q in enumerate(quotas)], "number int, cell_size long")
    cell = lambda at: F.floor(at / F.col("cell_size")).cast("long")
    cuts, cuts_at = stage(shard_cuts(spark, quotas, shards, seed).join(cells, "number").withColumn("cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to") - 1)))), "cuts")
    mixed = drawn.join(cells, "number").withColumn("cell", cell(F.col("nth"))).join(cuts.drop("cell_size"), ["number", "cell"]).where((F.col("nth") >= F.col("from")) & (F.col("nth") < F.col("to")))
    taken, _ = stage(mixed.withColumn("place", F.xxhash64("u", "shard", "copy")).select("row", "doc_id", "text_hash", "k1", "k2", "block", "start", "length", "copy", "shard", "place"), "taken")
    remove(spark, placed_at, drawn_at, cuts_at)
    return informed, taken


def mix_digest(documents: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words that shards take, repeats counted), n_blocks, n_shards."""
    docs, taken = mix_plan(documents, **options)
    per_doc = taken.groupBy("row").agg(F.sum("length").alias("taken"), F.count("*").alias("n_blocks"), F.size(F.collect_set("shard")).cast("long").alias("n_shards"))
    zero = F.lit(0).cast("long")
    return docs.join(per_doc, "row", "left").select("doc_id", "size", "source_size", "target", *[F.coalesce(c, zero).alias(c) for c in ("taken", "n_blocks", "n_shards")])


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix in whole documents, with all their columns, as often as each is taken, by shard and shuffled there.

    Documents without a word (null texts too) are not in it. Rows that repeat a doc_id or text are
    documents of their own, each with its own columns; rows that are equal in every column are
    interchangeable. An empty table gives no row. Columns of any names pass through.
    """
    _, taken = mix_plan(documents, block_words=None, **options)
    names = fresh(documents, "k1", "k2", "shard", "place")
    a, b, shard, place = names
    plan = taken.select(*[F.col(c).alias(n) for c, n in zip(("k1", "k2", "shard", "place"), names, strict=True)])
    key = dict(zip((a, b), _row_keys(documents), strict=True))
    keyed = documents.withColumns(key)
    rows = taken.select("k1", "k2", "row").distinct().groupBy(F.col("k1").alias(a), F.col("k2").alias(b)).agg(F.count("*").alias(shard))
    repeated, _ = stage(rows.where(F.col(shard) > 1).select(a, b), "repeated")
    if not repeated.isEmpty():
        keyed = keyed.join(repeated, [a, b], "left_anti").unionByName(keyed.join(repeated, [a, b], "left_semi").dropDuplicates([a, b]))
    out = keyed.join(plan, [a, b])
    return out.repartition(shard).sortWithinPartitions(shard, place).select(*columns_of(documents))
