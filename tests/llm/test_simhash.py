from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from wavelark.llm import simhash
from wavelark.llm.simhash import build_top, deal, fingerprint, keep_one, link_forest, plan_shards, route, simhash_near_dedup

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("low", T.LongType())])


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[root(i)].append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    fps = [plain(t) for _, t in rows]
    comp = components(fps, [d for d, _ in rows])
    want = sorted(((d, f"{f:016x}", comp[i]) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_near_dedup(df).collect()), key=str) == want
    return want


def test_documents_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", 30)
    want = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert len({w[2] for w in want}) < len(want)


def test_nulls_ties_long_and_empty(spark):
    rows = [(3, None), (1, ""), (2, " \n"), (4, "one two"), (4, "one two"), (None, "ONE  two"), (None, "lonely é"), (7, "a " * 20000), (8, "A " * 20001), (9, "x y z w v u")]
    check(spark.createDataFrame([(*r, "z", 0) for r in rows], SCHEMA))
    assert simhash_near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = keep_one(spark.createDataFrame([(*r, "z", 0) for r in rows], SCHEMA))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 7, 9, None] and kept.columns == ["doc_id", "text", "fp", "low"]


@pytest.mark.parametrize("n,spread", [(3000, 64), (3000, 10)])
def test_tree_loses_no_link(n, spread):
    rng = np.random.default_rng(1)
    points = rng.integers(0, 2**63, n, dtype=np.uint64) & np.uint64((1 << spread) - 1 if spread < 64 else 2**64 - 1)
    points = np.unique(np.concatenate((points, points[:200] ^ np.uint64(0b1011), points[:100] ^ np.uint64(0b11110000))))
    tree = build_top(points[::3], len(points), 200)
    who, where, home = route(tree, points, 4)
    assert home.sum() == len(points)
    shards = 1 + int(where.max())
    tasks = defaultdict(lambda: ([], []))
    for shard, part, slice_, which, own in deal(tree, np.full(shards, 2), 1 + np.arange(shards) % 3, points, 4):
        for key, w in zip(zip(shard.tolist(), part.tolist(), slice_.tolist(), strict=True), which.tolist(), strict=True):
            tasks[key][0 if own else 1].append(w)
    parent = {int(p): int(p) for p in points}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for mine, others in tasks.values():
        a, b = link_forest(points[np.array(mine, int)], points[np.array(others, int)], 4)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            parent[root(x)] = root(y)
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4)
    assert all(root(int(points[x])) == root(int(points[y])) for x, y in zip(i, j, strict=True) if x < y)
    true = {int(p): int(p) for p in points}

    def troot(x):
        while true[x] != x:
            x = true[x]
        return x

    for x, y in zip(i, j, strict=True):
        if x < y:
            true[troot(int(points[x]))] = troot(int(points[y]))
    assert len({troot(int(p)) for p in points}) == len({root(int(p)) for p in points})


def test_fingerprint_equals_plain_definition():
    for t in ("", "A b", "a b c d", "É b C d e f g " * 9, "\x0ba\x1fb c d e f"):
        assert fingerprint(t.encode()) == plain(t)


@pytest.mark.parametrize("total", [10**6, 10**8])
def test_tasks_stay_bounded(total):
    rng = np.random.default_rng(2)
    tree, parts, slices = plan_shards(np.sort(rng.integers(0, 2**64, min(simhash.SAMPLE_MOST, total // 1000), dtype=np.uint64)), total, 4)
    points = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    _, where, home = route(tree, points, 4)
    own, all_ = (np.bincount(x, minlength=len(parts)) * (total / len(points)) for x in (where[home], where))
    noise = 6 * np.sqrt(total / len(points))
    assert (own / parts <= 2 * simhash.SHARD_POINTS * 1.5 + noise * np.sqrt(own / parts)).all()
    assert (all_ / slices <= simhash.SLICE_POINTS * 1.5 + noise * np.sqrt(all_ / slices)).all()


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e", 5, 6), (2, "a b c d e", 7, 8), (2, "a b c d e", 9, 9), (3, "q r s t u v w x", 1, 2)], "doc_id long, text string, kept_id int, `__text_hash` int")
    assert sorted(map(tuple, keep_one(df).collect())) == [(1, "a b c d e", 5, 6), (3, "q r s t u v w x", 1, 2)]
    again = df.where("doc_id = 2")
    assert keep_one(again).count() == 1 and keep_one(df.limit(0)).collect() == [] and keep_one(df).columns == df.columns
