from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from wavelark.llm import mixing
from wavelark.llm.mixing import draw, hypergeometric, mix_digest, mix_documents, mix_plan, shard_cuts, splitting_tree, targets

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("row", T.LongType()), T.StructField("shard", T.StringType())])


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    lo, hi = 0.0, 1e18
    total = 1.5 * sum(sizes.values())
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * sizes[s], mid * w[s]) for s in order) < total else (lo, mid)
    return {s: min(2 * sizes[s], hi * w[s]) for s in order}


def check(df, tolerance, **options):
    rows = mix_digest(df, **options).collect()
    texts = defaultdict(list)
    size = defaultdict(int)
    for r in df.collect():
        n = len((r.text or "").encode().split())
        size[r.source] += n
        texts[r.doc_id].append((n, r.source))
    want, by = brute_targets(size), defaultdict(int)
    source = {d: v[0][1] for d, v in texts.items()}
    assert sorted(r.size for r in rows) == sorted(n for v in texts.values() for n, _ in v)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6) and 0 <= r.taken <= 2 * r.size
        by[s] += r.taken
    assert all(abs(by[s] - want[s]) <= tolerance for s in size)
    return sorted(((r.doc_id, r.taken) for r in rows), key=str)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 20_000)
    monkeypatch.setattr(mixing, "BUCKET_BLOCKS", 50)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert check(df, 130) == check(df.repartition(5), 130)
    _, taken = mix_plan(df)
    blocks = taken.collect()
    assert len({(b.row, b.block, b.copy) for b in blocks}) == len(blocks) and len({b.shard for b in blocks}) > 5
    sums = defaultdict(int)
    for b in blocks:
        sums[b.shard] += 1
    assert max(sums.values()) - min(sums.values()) <= 2


def test_edges(spark):
    rows = [(1, None, "a", 0, ""), (2, "", "b", 0, ""), (3, "x " * 3000, "a", 0, ""), (4, "y z", None, 0, ""), (4, "y z", None, 0, ""), (None, "q\x0bq\x1fq", None, 0, ""), (6, "w " * 700, "é", 0, ""), (7, None, "empty", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    check(df, 130)
    assert mix_digest(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mix_documents(df)
    assert got.columns == SCHEMA.names and all(r.text for r in got.collect())


def test_whole_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert mix_documents(df).count() == sum(r.n_blocks for r in mix_digest(df, block_words=None).collect())


def split_quotas(quota, shards, seed):
    out = np.zeros((shards, len(quota)), int)
    for shard, _, sources, have, ahead in splitting_tree(0, shards, np.arange(len(quota)), quota, np.zeros(len(quota), int), seed):
        assert (ahead == out[:shard, sources].sum(0)).all()
        out[shard, sources] = have
    return out


def test_tree_keeps_quotas_and_deals_fairly():
    quota = np.array([1000, 10, 0, 300])
    got = split_quotas(quota, 7, 3)
    assert (got.sum(0) == quota).all() and np.ptp(got.sum(1)) <= 4 and (got == split_quotas(quota, 7, 3)).all()
    assert targets({"a": 0}) == {"a": 0.0} and targets({}) == {}
    many = np.mean([split_quotas(np.array([100, 300]), 4, s)[0] for s in range(400)], axis=0)
    assert np.allclose(many, [25, 75], atol=1.5)


def test_draws_beyond_numpys_bound_follow_the_distribution(monkeypatch):
    rng = np.random.default_rng(5)
    want = rng.hypergeometric(300, 700, 250, 20_000)
    monkeypatch.setattr(mixing, "NUMPY_MOST", 0)
    got = np.array([hypergeometric(rng, 300, 700, 250) for _ in range(20_000)])
    assert abs(got.mean() - 75) < 0.2 and abs(got.std() - want.std()) < 0.15 and got.min() >= 0
    assert np.abs(np.quantile(got, [0.05, 0.5, 0.95]) - np.quantile(want, [0.05, 0.5, 0.95])).max() <= 1
    monkeypatch.undo()
    have = np.array([6_000_000_000, 0, 3_000_000_000, 1])
    part = draw(rng, have, 4_500_000_000)
    assert part.sum() == 4_500_000_000 and (part <= have).all() and abs(part[0] - 3_000_000_000) < 300_000 and part[0] != 3_000_000_000


def test_cuts_of_tasks_equal_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOP_NODES", 3)
    quota = np.array([500, 0, 70])
    want = split_quotas(quota, 11, 7)
    ends = np.cumsum(want, axis=0)
    rows = sorted((r.number, r.shard, r["from"], r["to"]) for r in shard_cuts(spark, quota, 11, 7).collect())
    assert rows == sorted((k, s, ends[s, k] - want[s, k], ends[s, k]) for s in range(11) for k in range(3) if want[s, k])


def test_the_mix_is_what_the_tree_deals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 20_000)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r.doc_id: (r.taken, r.n_shards) for r in mix_digest(df).collect()}
    assert max(n for _, n in whole.values()) > 1
    tree = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda lo, hi, *a: [x for x in tree(lo, hi, *a) if x[0] > 0])
    less = {r.doc_id: r.taken for r in mix_digest(df).collect()}
    assert sum(less.values()) < sum(t for t, _ in whole.values()) and all(less[d] <= whole[d][0] for d in less)
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a: [])
    assert not any(r.taken for r in mix_digest(df).collect())


def test_repeated_rows_keep_their_own_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 1, "p"), (1, "a b c", "t", 2, "q"), (1, "a b c", "t", 2, "q"), (2, "d " * 50, "u", 3, "r")], SCHEMA)
    got, plan = mix_documents(df, weights=(1,)), mix_plan(df, block_words=None, weights=(1,))[1]
    assert got.columns == df.columns and got.count() == plan.count() > 0
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in df.collect()}
    assert sum(r.source == "t" for r in got.collect()) == plan.join(df.where("source = 't'").limit(1).selectExpr("xxhash64(*) AS k1"), "k1").count()
    assert mix_documents(df.limit(0)).collect() == []
