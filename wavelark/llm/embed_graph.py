"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors are one point from the start. Centroids, fitted on a bounded sample, cut the points into
clusters; every point is a member of its two nearest ones, so clusters overlap. A cluster above the size
of a shard is cut again by centroids of its own, level by level, and one that no centroids divide is
cut by hash; so shards stay bounded however many points there are, and a point is routed through as many
levels, not past all shards. In each shard, neighbours of a member are pruned so that those kept point in
different directions (robust pruning); the lists that a point gets in its two shards are united.

The search walks this graph from the medoids of the nearest shards (and the point itself where it is a
member), greedily to its surroundings and on through everything within the range until nothing new is
found. Queries that are near one another walk as a block: they share the set of visited members, each of
which costs one row of a matrix product, so that a block never costs more than comparing it with its
whole shard, and a dense cluster of many members no more than its own product. Where a walk meets a link
whose home is a shard that the query was not sent to, the query goes on there in another round: members
of two shards are the graph's way from one to the other. A cluster that lies within the range of a query
as a whole (by the triangle bound on angles) is counted from its summary and not searched.

Links are verified in double precision at the range's border. A bounded sample of points, outside the one
that centroids were fitted on as far as there are such, is compared with all others. Where its neighbours
are at home says how many clusters a point must visit: that number is measured, not fixed. Recall is
averaged over points that have links, over all of them and over those outside the largest cluster, and
both must do. Every round is audited: where recall falls short, the search is repeated wider, in the end
as a comparison of all points with all, which is exact; if even that falls short, it is an error. A shard
returns counts and a forest of links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Union, parallelism, remove, stage
from .components import connected_components

#: Vectors that centroids are fitted on, centroids of a level, points per centroid, members per shard and queries per task aimed at.
SAMPLE, MAX_CENTROIDS, CENTROID_POINTS, SHARD_POINTS, SLICE_QUERIES = 20_000, 1024, 1000, 8000, 32_000
#: Levels of centroids, after which what is too large is cut by hash.
LEVELS = 6
#: Kept neighbours, candidates for them, random ones among these, and the pruning's slack.
DEGREE, CANDIDATES, RANDOM, ALPHA = 24, 32, 4, 1.2
#: Queries that walk as a block, medoids they set out from, and how far outside the range members are still walked through.
BLOCK, MEDOIDS, SLACK = 128, 16, 0.1
#: Cosines in single precision this close to the range's border are computed again in double.
BORDER = 2e-5
#: Points whose links are found by brute force for the audit, and the recall below which the search is widened.
AUDIT, MIN_RECALL = 256, 0.95
#: Linked points outside the largest cluster that the audit looks for, and the most points it asks for them.
ENOUGH, MAX_AUDIT = 32, 4096
#: Queries a shard may get on average before a wider search becomes the exact one, and points of its blocks.
QUERY_ROWS, BLOCK_POINTS = 100_000, 20_000
#: Share of the audited points' links that the first round's visits must lead to.
ROUTED = 0.98

_MEMBER = "cluster long, cid long, home boolean, n long, angle double, vec binary"
_ROUTED = "cluster long, cid long, vec binary, links long, a long, b long"


def _vectors(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def points_of(embeddings: DataFrame) -> DataFrame:
    """embeddings -> vec_id, vec (doubles as bytes, scaled to a largest component of 1; null where a vector links with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            out, begin = [], 0
            for end in ends.tolist():
                a, begin = values[begin:end], end
                top = np.abs(a).max(initial=0.0)
                out.append((a / top + 0.0).tobytes() if np.isfinite(top) and top > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).mapInArrow(run, "vec_id long, vec binary")


def fit_centroids(sample: np.ndarray, total: int) -> np.ndarray:
    """Unit centroids by a few rounds of spherical k-means; their number grows with the points up to a bound."""
    k = int(min(MAX_CENTROIDS, max(1, total // CENTROID_POINTS), max(1, len(sample) // 4)))
    rng = np.random.default_rng(5)
    centers = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(6 if k > 1 else 1):
        near = np.concatenate([np.argmax(sample[i : i + 2048] @ centers.T, axis=1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        lengths = np.linalg.norm(sums, axis=1)
        centers = np.where(lengths[:, None] > 1e-12, sums / np.maximum(lengths, 1e-12)[:, None], centers)
    return centers


def robust_prune(vectors: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(members, DEGREE) neighbours, -1 where there are no more: nearest first; one that a kept neighbour is much nearer to than the point itself is dropped."""
    n = len(vectors)
    out = np.full((n, DEGREE), -1, np.int64)
    if n < 2:
        return out
    take = min(CANDIDATES, n - 1)
    for lo in range(0, n, 512):
        rows = np.arange(lo, min(n, lo + 512))
        each = np.arange(len(rows))
        sims = vectors[rows] @ vectors.T
        sims[each, rows] = -np.inf
        cand = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        cand = np.concatenate((cand, rng.integers(0, n, (len(rows), RANDOM))), axis=1)
        near = np.take_along_axis(sims, cand, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, axis=1), np.take_along_axis(near, order, axis=1)
        alive = np.isfinite(near)
        alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        picked = vectors[cand]
        among = picked @ picked.transpose(0, 2, 1)
        for slot in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            best = np.argmax(alive, axis=1)
            out[rows[some], slot] = cand[some, best[some]]
            # Distances are 2 - 2 cos: drop c if ALPHA * d(best, c) <= d(point, c).
            alive &= ALPHA * (1 - among[each, best]) > (1 - near)
            alive[each, best] = False
    return out


def both_ways(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours kept by either end, as (where each member's list begins, the lists)."""
    a, slot = np.nonzero(kept >= 0)
    if not len(a):
        return np.zeros(len(kept) + 1, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate((np.stack((a, kept[a, slot])), np.stack((kept[a, slot], a))), axis=1), axis=1)
    return np.concatenate(([0], np.cumsum(np.bincount(pairs[0], minlength=len(kept))))), pairs[1]


def _lists_of(begin: np.ndarray, lists: np.ndarray, who: np.ndarray) -> np.ndarray:
    size = begin[who + 1] - begin[who]
    return lists[np.repeat(begin[who] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def block_search(vectors: np.ndarray, begin: np.ndarray, lists: np.ndarray, queries: np.ndarray, own: np.ndarray, at_least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of a block's queries, members visited, cosines in single precision); own: the member that a query is, or -1.

    A member is walked through if it is among the `beam` best that some query of the block has met, or
    nearly within its range.
    """
    n = len(vectors)
    pivots = vectors[np.linspace(0, n - 1, min(n, MEDOIDS)).astype(int)]
    side = np.argmax(vectors @ pivots.T, axis=1)
    sums = np.stack([vectors[side == k].sum(axis=0) for k in range(len(pivots))] + [vectors.sum(axis=0)])
    medoids = np.unique(np.argmax(sums @ vectors.T, axis=1))
    order = np.argsort(np.argmax(queries @ vectors[medoids].T, axis=1), kind="stable")
    for lo in range(0, len(queries), BLOCK):
        which = order[lo : lo + BLOCK]
        q, mine = queries[which], own[which]
        seen, members, sims = np.zeros(n, bool), [], []
        best = np.full((len(q), beam), -np.inf, vectors.dtype)
        front = np.unique(np.concatenate((medoids, mine[mine >= 0])))
        while len(front):
            seen[front] = True
            s = q @ vectors[front].T
            members.append(front)
            sims.append(s)
            best = np.partition(np.concatenate((best, s), axis=1), s.shape[1], axis=1)[:, -beam:]
            bar = np.minimum(best.min(axis=1), at_least - SLACK)
            reached = np.unique(_lists_of(begin, lists, front[(s >= bar[:, None]).any(axis=0)]))
            front = reached[~seen[reached]]
        yield which, np.concatenate(members), np.concatenate(sims, axis=1)


def within(sims: np.ndarray, q: np.ndarray, v: np.ndarray, at_least: float) -> np.ndarray:
    """Whether each cosine is at_least or more, decided in double precision near the border; q, v: the vectors in double."""
    ok = sims >= at_least
    r, c = np.nonzero(np.abs(sims - at_least) <= BORDER)
    for lo in range(0, len(r), 100_000):
        a, b = r[lo : lo + 100_000], c[lo : lo + 100_000]
        ok[a, b] = np.einsum("rd,rd->r", q[a], v[b]) >= at_least
    return ok


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def inside(sims: np.ndarray, radius: np.ndarray, at_least: float) -> np.ndarray:
    """Whether a cluster lies within the range as a whole: the angle to its centroid and its radius together are below the range's."""
    return _angle(sims) + radius <= _angle(np.float64(at_least)) - 1e-7


def possible(sims: np.ndarray, centers: np.ndarray, near: np.ndarray, radius: np.ndarray, at_least: float) -> np.ndarray:
    """Whether each of the clusters `near` (nearest first) can be home to a point within the range: none is if it lies wholly beyond the border to the nearest centroid's half-space, or farther away than its radius and the range."""
    apart = np.linalg.norm(centers[near] - centers[near[:, :1]], axis=2)
    s = np.take_along_axis(sims, near, axis=1)
    t = max(0.0, at_least)
    return (t * (s[:, :1] - s) <= apart * np.sqrt(max(0.0, 1 - t**2)) + 1e-9) & (_angle(s) <= _angle(np.float64(at_least)) + radius[near] + 1e-7)


def nearest(sims: np.ndarray, m: int) -> np.ndarray:
    near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable"), axis=1)


def enter(pdf: pd.DataFrame, centers: np.ndarray, first: int, overlap: int) -> Iterator[pd.DataFrame]:
    """Members of a cluster (its `home` as it is) as members of its nearest parts, numbered from `first`."""
    for lo in range(0, len(pdf), 4096):
        part = pdf.iloc[lo : lo + 4096]
        sims = _unit(_vectors(part["vec"])) @ centers.T
        near = nearest(sims, min(overlap, len(centers)))
        for k in range(near.shape[1]):
            yield pd.DataFrame({"cluster": first + near[:, k], "cid": part["cid"], "home": part["home"] & (k == 0), "n": part["n"], "angle": _angle(sims[np.arange(len(near)), near[:, k]]), "vec": part["vec"]})


def visit(pdf: pd.DataFrame, centers: np.ndarray, first: int, about: pd.DataFrame, visits: int, at_least: float) -> Iterator[pd.DataFrame]:
    """Queries of a cluster as queries of its parts; parts within the range as a whole are counted (links) and tied (a, b) instead.

    about: number of a part, radius, n, low (of points at home there, the weight and smallest cid).
    """
    k = len(centers)
    radius, weight, low = np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64)
    at = about["number"].to_numpy(dtype=np.int64)
    radius[at], weight[at], low[at] = about["radius"], about["n"], about["low"]
    for lo in range(0, len(pdf), 1024):
        part = pdf.iloc[lo : lo + 1024]
        sims = _unit(_vectors(part["vec"])) @ centers.T
        near = nearest(sims, min(visits, k))
        whole = inside(sims, radius[None, :], at_least) & (weight > 0)
        use = np.concatenate([possible(sims[i : i + 256], centers, near[i : i + 256], radius, at_least) for i in range(0, len(near), 256)])
        use &= ~np.take_along_axis(whole, near, axis=1) & (weight[near] > 0)
        r, c = np.nonzero(use)
        yield pd.DataFrame({"cluster": first + near[r, c], "cid": part["cid"].to_numpy()[r], "vec": part["vec"].to_numpy()[r], "links": pd.array([None] * len(r), "Int64"), "a": pd.array([None] * len(r), "Int64"), "b": pd.array([None] * len(r), "Int64")})
        some = np.flatnonzero(whole.any(axis=1))
        if not len(some):
            continue
        cid = part["cid"].to_numpy()
        at_home = part["own"].to_numpy() & whole[np.arange(len(part)), near[:, 0]]
        links = whole @ weight.astype(np.float64) - np.where(at_home, part["n"].to_numpy(), 0)
        union = Union(len(part) + k)
        q, p = np.nonzero(whole)
        union.link(q, p + len(part))
        name = np.concatenate((cid, low))
        tied = np.flatnonzero(union.label != np.arange(len(name)))
        yield pd.DataFrame({"cluster": -1, "cid": cid[some], "vec": None, "links": links[some].astype(np.int64), "a": pd.array([None] * len(some), "Int64"), "b": pd.array([None] * len(some), "Int64")})
        yield pd.DataFrame({"cluster": -1, "cid": -1, "vec": None, "links": pd.array([None] * len(tied), "Int64"), "a": name[tied], "b": name[union.label[tied]]})


def _about(members: DataFrame, fan: int) -> DataFrame:
    """cluster, parent, number, radius, n, low of the clusters that are home to points."""
    cluster = F.col("cluster")
    parts = members.where("home").groupBy("cluster").agg(F.max("angle").alias("radius"), F.sum("n").alias("n"), F.min("cid").alias("low"))
    return parts.select("cluster", F.floor((cluster - 1) / fan).cast("long").alias("parent"), F.pmod(cluster - 1, F.lit(fan)).cast("int").alias("number"), "radius", "n", "low")


class Routing:
    """Points dealt to shards, level by level, under `folder`s of their own (paths).

    A cluster's parts are numbered 1 + cluster * fan + number, so its ancestors follow from its number;
    the whole is 0. members: cluster, cid, home, n, vec; queries: cluster, cid, vec; links: what whole
    clusters gave; regions: cluster, center, radius of every level.
    """

    def __init__(self, points: DataFrame, centers: np.ndarray, at_least: float, visits: int):
        self.spark, self.at_least, self.paths = points.sparkSession, at_least, []
        self.fan, self.width = MAX_CENTROIDS, 8 * centers.shape[1]
        fan, spread = self.fan, points.select("cid", "n", "vec", F.lit(True).alias("home"), F.lit(True).alias("own"))

        def enter_all(batches):
            for pdf in batches:
                yield from enter(pdf, centers, 1, 2)

        members = self._staged(spread.mapInPandas(enter_all, _MEMBER), "members")
        about = _about(members, fan).toPandas()

        def visit_all(batches):
            for pdf in batches:
                yield from visit(pdf, centers, 1, about, visits, at_least)

        routed = self._staged(spread.mapInPandas(visit_all, _ROUTED), "routed")
        known = [(1 + int(i), centers[int(i)].tobytes(), float(r)) for i, r in zip(about["number"], about["radius"], strict=True)]
        self.regions = self.spark.createDataFrame(known, "cluster long, center binary, radius double")
        self.members, self.links, self.queries, level = members, routed.where("cluster < 0"), routed.where("cluster >= 0"), 1
        while level < LEVELS and self._deeper(visits):
            level += 1

    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        out, path = stage(df, name)
        self.paths.append(path)
        return out

    def _deeper(self, visits: int) -> bool:
        """Cuts the clusters above SHARD_POINTS by centroids of their own; whether there were any."""
        fan, at_least = self.fan, self.at_least
        large = self.members.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") > SHARD_POINTS)
        if large.isEmpty():
            return False
        large = self._staged(large.select("cluster", "size", F.ceil(F.col("size") / (4 * SLICE_QUERIES)).cast("int").alias("slices")), "large")
        mine = self.members.join(large, "cluster")
        picked = mine.where(F.pmod(F.xxhash64("cid", F.lit("fit")), F.col("size")) < SAMPLE)

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            centers = fit_centroids(_unit(_vectors(pdf.sort_values(["cid", "home"])["vec"])), int(pdf["size"].iloc[0]))
            return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "centers": [centers.tobytes()]})

        fitted = self._staged(picked.groupBy("cluster").applyInPandas(fit, "cluster long, centers binary"), "centers")
        of_slices = fitted.join(large, "cluster").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        slice_ = F.pmod(F.xxhash64("cid"), F.col("slices").cast("long")).cast("int").alias("slice")

        def centers_of(c: pd.DataFrame, pdf: pd.DataFrame) -> np.ndarray:
            return np.frombuffer(c["centers"].iloc[0], np.float64).reshape(-1, len(pdf["vec"].iloc[0]) // 8)

        def enter_one(pdf: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf) or not len(c):
                return pd.DataFrame({x.split()[0]: [] for x in _MEMBER.split(", ")})
            return pd.concat(list(enter(pdf, centers_of(c, pdf), 1 + int(pdf["cluster"].iloc[0]) * fan, 1)))

        keyed = mine.select("cluster", "cid", "home", "n", "vec", slice_)
        parts = self._staged(_anew(keyed, *keyed.columns).groupBy("cluster", "slice").cogroup(_anew(of_slices, *of_slices.columns).groupBy("cluster", "slice")).applyInPandas(enter_one, _MEMBER), "members")
        about = self._staged(_about(parts, fan), "about")
        gathered = about.groupBy(F.col("parent").alias("cluster")).agg(F.collect_list(F.struct("number", "radius", "n", "low")).alias("about"))
        homes = mine.where("home").select("cluster", F.col("cid").alias("c"), F.col("n").alias("weight"))
        asking = self.queries.join(large, "cluster").join(homes.withColumnRenamed("cluster", "k"), (F.col("cluster") == F.col("k")) & (F.col("cid") == F.col("c")), "left")
        asking = asking.select("cluster", "cid", "vec", F.coalesce("weight", F.lit(0)).alias("n"), F.col("weight").isNotNull().alias("own"), slice_)

        def visit_one(pdf: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf) or not len(c):
                return pd.DataFrame({x.split()[0]: [] for x in _ROUTED.split(", ")})
            about = pd.DataFrame([r.asDict() if hasattr(r, "asDict") else dict(r) for r in c["about"].iloc[0]])
            return pd.concat(list(visit(pdf, centers_of(c, pdf), 1 + int(pdf["cluster"].iloc[0]) * fan, about, visits, at_least)))

        knows = of_slices.join(gathered, "cluster")
        routed = self._staged(_anew(asking, *asking.columns).groupBy("cluster", "slice").cogroup(_anew(knows, *knows.columns).groupBy("cluster", "slice")).applyInPandas(visit_one, _ROUTED), "routed")
        center = fitted.select(F.col("cluster").alias("parent"), "centers").join(about, "parent").withColumn("width", F.lit(self.width))
        self.regions = self.regions.unionByName(center.select("cluster", F.expr("substring(centers, number * width + 1, width)").alias("center"), "radius"))
        rest = self.members.join(large, "cluster", "left_anti")
        self.members = self._staged(rest.unionByName(parts), "members")
        self.queries = self._staged(self.queries.join(large, "cluster", "left_anti").unionByName(routed.where("cluster >= 0")), "queries")
        self.links = self.links.unionByName(routed.where("cluster < 0"))
        return True

    def unseen(self, pairs: DataFrame) -> DataFrame:
        """pairs(cluster, cid, vec) without those whose cluster, or one that it is a part of, lies within the range of the query as a whole: it is counted already."""
        up = [F.col("cluster")]
        for _ in range(LEVELS - 1):
            up.append(F.floor((up[-1] - 1) / self.fan).cast("long"))
        at_least = self.at_least

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    cosine = np.einsum("rd,rd->r", _unit(_vectors(pdf["vec"])), _vectors(pdf["center"]))
                    yield pdf.loc[inside(cosine, pdf["radius"].to_numpy(), at_least), ["cluster", "cid"]]

        regions = self.regions.select(F.col("cluster").alias("up"), "center", "radius")
        counted = pairs.withColumn("up", F.explode(F.filter(F.array(*up), lambda x: x > 0))).join(regions, "up").select("cluster", "cid", "vec", "center", "radius")
        return pairs.join(counted.mapInPandas(judge, "cluster long, cid long").distinct(), ["cluster", "cid"], "left_anti")


def _graph(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pruned neighbours of a shard's members, both ways, and the cluster of those at home here."""
    pdf = pdf.sort_values("cid")
    cid = pdf["cid"].to_numpy()
    begin, lists = both_ways(robust_prune(_unit(_vectors(pdf["vec"])).astype(np.float32), np.random.default_rng(len(pdf))))
    return pd.DataFrame({"cid": cid, "near": np.split(cid[lists], begin[1:-1]) if len(cid) else [], "at": pdf["cluster"].where(pdf["home"]).astype("Int64")})


def _search(members: pd.DataFrame, queries: pd.DataFrame, at_least: float, beam: int) -> pd.DataFrame:
    """Rows of a, the query, with: links (copies counted; b, to null), b (a link of the shard's forest) or to (a cluster to go on to)."""
    columns = {"a": "int64", "b": "Int64", "links": "Int64", "to": "Int64"}
    if not len(members) or not len(queries):
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()})
    members = members.sort_values("cid")
    cid, home, weight, at = members["cid"].to_numpy(), members["home"].to_numpy(), members["n"].to_numpy(), members["at"].to_numpy()
    unit, asked, who = _unit(_vectors(members["vec"])), _unit(_vectors(queries["vec"])), queries["cid"].to_numpy()

    def place(ids: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(cid, ids), len(cid) - 1)
        return np.where(cid[k] == ids, k, -1)

    near = [np.asarray(x, np.int64) for x in members["near"]]
    found = place(np.concatenate(near))
    begin = np.concatenate(([0], np.cumsum(found >= 0)))[np.concatenate(([0], np.cumsum([len(x) for x in near])))]
    own = place(who)
    links, union, onward = np.zeros(len(who), np.int64), Union(len(cid) + len(who)), []
    union.link(np.flatnonzero(own >= 0) + len(cid), own[own >= 0])
    for which, seen, sims in block_search(unit.astype(np.float32), begin, found[found >= 0], asked.astype(np.float32), own, at_least, beam):
        ok = within(sims, asked[which], unit[seen], at_least) & (seen[None, :] != own[which][:, None])
        here = home[seen]
        links[which] = ok[:, here] @ weight[seen][here].astype(np.float64)
        q, m = np.nonzero(ok & (union.label[which + len(cid)][:, None] != union.label[seen][None, :]))
        union.link(which[q] + len(cid), seen[m])
        q, m = np.nonzero(ok[:, ~here])
        if len(q):
            onward.append(np.unique(np.stack((who[which[q]], at[seen[~here][m]])), axis=1))
    name = np.concatenate((cid, who))
    tied, some = np.flatnonzero(name != name[union.label]), np.flatnonzero(links)
    onward = np.concatenate(onward, axis=1) if onward else np.zeros((2, 0), np.int64)
    none = lambda n: pd.array([None] * n, "Int64")
    return pd.concat(
        [
            pd.DataFrame({"a": who[some], "b": none(len(some)), "links": pd.array(links[some], "Int64"), "to": none(len(some))}),
            pd.DataFrame({"a": name[tied], "b": pd.array(name[union.label[tied]], "Int64"), "links": none(len(tied)), "to": none(len(tied))}),
            pd.DataFrame({"a": onward[0], "b": none(onward.shape[1]), "links": none(onward.shape[1]), "to": pd.array(onward[1], "Int64")}),
        ]
    )


def _anew(df: DataFrame, *names: str) -> DataFrame:
    """These columns under new identities, so that two tables of one origin can be told apart."""
    return df.select(*[F.col(n).alias(n) for n in names])


def _links(points: DataFrame, centers: np.ndarray, at_least: float, visits: int, beam: int) -> tuple[DataFrame, list[str]]:
    """(a, b, links) rows of all shards and rounds, staged."""
    routing = Routing(points, centers, at_least, visits)
    paths = routing.paths
    sizes = routing.members.groupBy("cluster").agg(F.ceil(F.count("*") / SHARD_POINTS).cast("int").alias("parts"))
    members = routing.members.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("cid", F.lit("part")), F.col("parts").cast("long")).cast("int"))
    graph = members.groupBy("cluster", "part").applyInPandas(_graph, "cid long, near array<long>, at long")
    united = graph.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("at").alias("at"))
    shards, path = stage(members.select("cluster", "part", "parts", "cid", "home", "n", "vec").join(united, "cid"), "graph")
    paths.append(path)
    out = routing.links.select(F.coalesce("a", "cid").alias("a"), "b", "links")
    asked, visited = routing.queries.select("cluster", "cid", "vec"), None
    while True:
        slices = asked.groupBy("cluster").agg(F.ceil(F.count("*") / SLICE_QUERIES).cast("int").alias("slices"))
        key = ["cluster", "part", "slice"]
        held = shards.join(slices, "cluster").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        parts = shards.select("cluster", "part").distinct()
        sent = asked.join(slices, "cluster").withColumn("slice", F.pmod(F.xxhash64("cid", F.lit("slice")), F.col("slices").cast("long")).cast("int")).join(parts, "cluster")
        found, path = stage(
            _anew(held, *key, "cid", "home", "n", "vec", "near", "at").groupBy(*key).cogroup(_anew(sent, *key, "cid", "vec").groupBy(*key)).applyInPandas(lambda m, q: _search(m, q, at_least, beam), "a long, b long, links long, to long"),
            "links",
        )
        paths.append(path)
        out = out.unionByName(found.where("to is null").select("a", "b", "links"))
        pairs = asked.select("cluster", "cid")
        visited = pairs if visited is None else visited.unionByName(pairs)
        onward = found.where("to is not null").select(F.col("to").alias("cluster"), F.col("a").alias("cid")).distinct().join(visited, ["cluster", "cid"], "left_anti")
        onward, path = stage(onward.join(points.select("cid", "vec"), "cid").select("cluster", "cid", "vec"), "onward")
        paths.append(path)
        if onward.isEmpty():
            return out, paths
        asked, path = stage(routing.unseen(onward), "asked")
        paths.append(path)
        if asked.isEmpty():
            return out, paths


def _at_least(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of b) of different ids within the range; at its very border decided as the search does."""
    sims = a @ b.T
    q, i = np.nonzero((sims >= at_least - 1e-6) & (a_ids[:, None] != b_ids[None, :]))
    ok, edge = sims[q, i] >= at_least, np.flatnonzero(sims[q, i] < at_least + 1e-6)
    for lo in range(0, len(edge), 100_000):
        k = edge[lo : lo + 100_000]
        ok[k] = np.einsum("rd,rd->r", a[q[k]], b[i[k]]) >= at_least
    return q[ok], i[ok]


def exact_links(points: DataFrame, at_least: float) -> tuple[DataFrame, list[str]]:
    """(a, b, links) rows by brute force, staged: all points pass by one block of them after another."""
    blocks = max(1, -(-points.count() // BLOCK_POINTS))
    out, paths = None, []
    for block in range(blocks):
        held = points.where(F.pmod(F.xxhash64("cid", F.lit("block")), F.lit(blocks)) == block).select("cid", "n", "vec").toPandas()
        if not len(held):
            continue
        unit, ids, weight = _unit(_vectors(held["vec"])), held["cid"].to_numpy(), held["n"].to_numpy()

        def compare(batches: Iterator[pd.DataFrame], unit=unit, ids=ids, weight=weight) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lo in range(0, len(pdf), 128):
                    cid, v = pdf["cid"].to_numpy()[lo : lo + 128], _unit(_vectors(pdf["vec"].iloc[lo : lo + 128]))
                    q, i = _at_least(v, unit, cid, ids, at_least)
                    links, union = np.zeros(len(cid), np.int64), Union(len(cid) + len(ids))
                    np.add.at(links, q, weight[i])
                    union.link(q, i + len(cid))
                    name = np.concatenate((cid, ids))
                    found, tied = np.flatnonzero(links), np.flatnonzero(union.label != np.arange(len(name)))
                    yield pd.DataFrame({"a": cid[found], "b": pd.array([None] * len(found), "Int64"), "links": pd.array(links[found], "Int64")})
                    yield pd.DataFrame({"a": name[tied], "b": pd.array(name[union.label[tied]], "Int64"), "links": pd.array([None] * len(tied), "Int64")})

        part, path = stage(points.select("cid", "vec").mapInPandas(compare, "a long, b long, links long"), "links")
        out = part if out is None else out.unionByName(part)
        paths.append(path)
    return out, paths


def audit_points(points: DataFrame, size: int, fitted: int | None) -> pd.DataFrame:
    """cid, n, vec of `size` points in an order of their own; those outside the fit sample (hashes up to `fitted`) come first."""
    inside = F.lit(False) if fitted is None else F.xxhash64("cid") <= fitted
    return points.orderBy(inside, F.xxhash64("cid", F.lit("audit")), "cid").limit(size).select("cid", "n", "vec").toPandas()


def true_links(points: DataFrame, at_least: float, centers: np.ndarray | None = None, fitted: int | None = None) -> pd.DataFrame:
    """a, rank, there, largest: links (copies counted) that brute force finds of the audited points, by the place of the neighbours' home cluster among a's nearest.

    largest: whether a is in the largest cluster of audited points. More points are asked while few
    that have links are outside it.
    """
    size = AUDIT
    while True:
        asked = audit_points(points, size, fitted)
        true = _true_links(points, asked, at_least, centers)
        unit = _unit(_vectors(asked["vec"])) if len(asked) else np.zeros((0, 1))
        union = Union(len(asked))
        for lo in range(0, len(asked), 256):
            q, i = np.nonzero(unit[lo : lo + 256] @ unit.T >= at_least)
            union.link(q + lo, i)
        sizes = np.bincount(union.label, minlength=1)
        inside = asked["cid"][union.label == np.argmax(sizes)] if sizes.max() > 1 else []
        true["largest"] = true["a"].isin(inside)
        if true.loc[~true["largest"], "a"].nunique() >= ENOUGH or size >= MAX_AUDIT or len(asked) < size:
            return true
        size = MAX_AUDIT


def _true_links(points: DataFrame, asked: pd.DataFrame, at_least: float, centers: np.ndarray | None) -> pd.DataFrame:
    unit, ids = _unit(_vectors(asked["vec"])) if len(asked) else None, asked["cid"].to_numpy()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None if centers is None else unit @ centers.T
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo : lo + 1024]
                v, n = _unit(_vectors(part["vec"])), part["n"].to_numpy()
                q, i = _at_least(unit, v, ids, part["cid"].to_numpy(), at_least)
                rank = np.zeros(len(q), np.int64)
                if own is not None:
                    home = np.argmax(v @ centers.T, axis=1)
                    key, which = np.unique(q * len(centers) + home[i], return_inverse=True)
                    place = [int((own[a] > own[a, h]).sum()) for a, h in zip(key // len(centers), key % len(centers), strict=True)]
                    rank = np.array(place, np.int64)[which]
                yield pd.DataFrame({"a": ids[q], "rank": rank, "there": n[i]}).groupby(["a", "rank"], as_index=False).sum()

    if not len(asked):
        return pd.DataFrame({"a": [], "rank": [], "there": []}, dtype="int64")
    return points.select("cid", "n", "vec").mapInPandas(count, "a long, rank long, there long").groupBy("a", "rank").agg(F.sum("there").alias("there")).toPandas()


def visits_needed(true: pd.DataFrame) -> int:
    """Nearest clusters that are home to ROUTED of the links of audited points outside the largest cluster, averaged over these points."""
    part = true[~true["largest"]]
    if not len(part):
        return 1
    share = (part["there"] / part.groupby("a")["there"].transform("sum")).groupby(part["rank"]).sum().sort_index().cumsum() / part["a"].nunique()
    return int(share.index[int(np.argmax(share.to_numpy() >= ROUTED - 1e-9))]) + 1


def audit_recall(points: DataFrame, found: DataFrame, at_least: float, true: pd.DataFrame | None = None) -> float:
    """Share of its links that was found of an audited point, on average over those that brute force finds links of: over all or over those outside the largest cluster, whichever is less; 1 where there are none."""
    true = true_links(points, at_least) if true is None else true
    if not len(true):
        return 1.0
    each = true.groupby("a").agg(there=("there", "sum"), largest=("largest", "first"))
    got = {r.a: r.links for r in found.where(F.col("links").isNotNull() & F.col("a").isin([int(a) for a in each.index])).groupBy("a").agg(F.sum("links").alias("links")).collect()}
    share = np.array([min(t, got.get(a, 0)) / t for a, t in each["there"].items()])
    outside = share[~each["largest"].to_numpy()]
    return float(min(share.mean(), outside.mean() if len(outside) else 1.0))


def audited_near_dedup(embeddings: DataFrame, at_least: float = 0.9, visits: int = 3, beam: int = 16) -> tuple[DataFrame, dict[int, float]]:
    """embedding_near_dedup's rows, and the recall that its audit measured for each length of vectors (in bytes of doubles)."""
    spark = embeddings.sparkSession
    rows, _ = stage(points_of(embeddings).select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")), "vectors")
    good = rows.where("vec is not null")
    # Copies meet by 128 bits of hash, not by their bytes; their one row is the point.
    classes, classes_at = stage(good.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("vec").alias("vec")).select(F.monotonically_increasing_id().alias("cid"), "*", F.octet_length("vec").alias("width")), "classes")
    totals = {r.width: r["count"] for r in classes.groupBy("width").count().collect()}
    found, paths, recalls = None, [classes_at], {}
    for width in sorted(totals):
        points, total = classes.where(F.col("width") == width), totals[width]
        sample = points.select(F.xxhash64("cid").alias("h"), "cid", "vec").orderBy("h", "cid").limit(SAMPLE).toPandas()
        centers, fitted = fit_centroids(_unit(_vectors(sample["vec"])), total), int(sample["h"].iloc[-1])
        true = true_links(points, at_least, centers, fitted)
        wide, reach = min(len(centers), max(visits, min(visits_needed(true), QUERY_ROWS * len(centers) // total))), beam
        spread, exact = points.repartition(min(parallelism(spark), -(-total // 1000))), False
        while True:
            links, more = exact_links(spread, at_least) if exact else _links(spread, centers, at_least, wide, reach)
            paths += more
            recalls[width] = audit_recall(points, links, at_least, true)
            if recalls[width] >= MIN_RECALL:
                break
            if exact:
                raise RuntimeError(f"audited recall {recalls[width]:.4f} is below {MIN_RECALL} after a comparison of all points")
            exact = wide >= len(centers) or 2 * wide * total > QUERY_ROWS * len(centers)
            wide, reach = min(2 * wide, len(centers)), 2 * reach
        found = links if found is None else found.unionByName(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")), recalls
    tied, tied_at = connected_components(found.where("b is not null").select("a", "b"))
    member = classes.join(tied.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "h1", "h2", "n", "low", F.coalesce("component", "cid").alias("component"))
    counts = found.where("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    named = member.join(member.groupBy("component").agg(F.min("low").alias("component_id")), "component").join(counts, "cid", "left")
    named, _ = stage(named.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links"), "component_id"), "named")
    remove(spark, tied_at, *paths)
    linked = good.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone), recalls


def embedding_near_dedup(embeddings: DataFrame, at_least: float = 0.9, visits: int = 3, beam: int = 16) -> DataFrame:
    """embeddings(vec_id, embedding, ...) -> vec_id, n_links, component_id, kept; one row per input row.

    Vectors link at cosine >= at_least, copies of a vector included; none below it. Null, empty or zero
    vectors, and those with null or non-finite components, link with nothing. component_id is the
    smallest vec_id that links lead to (null ids name a component only where no other is in it), kept
    whether that is the row's own. Vectors of different lengths never link: each length is a table of
    its own. Repeated rows are copies and link. Copies are told by 128 bits of hash. An empty table gives
    no row. Other columns are ignored, whatever their names. The measured recall comes with
    audited_near_dedup, which this is.
    """
    return audited_near_dedup(embeddings, at_least, visits, beam)[0]
