"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Union, remove, stage

#: Links that one task may hold; what is fewer is settled there at once.
TASK_LINKS = 2_000_000


def _towards_minimum(edges: DataFrame) -> DataFrame:
    """One round: every node's neighbours, and the node, are tied to the smallest of them.

    Large step: a node's larger neighbours are tied to its smallest neighbour (or itself).
    Small step: a node and its smaller neighbours are tied to the smallest of them. Both keep
    connectivity. Minima come from a grouped aggregate that combines before the shuffle, and the
    join that follows may be split where a node has very many links.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(low, "a")
    return joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a partition as stars around the smallest node of each of its components."""
    parts = [pdf for pdf in batches if len(pdf)]
    if parts:
        a, b = (np.concatenate([p[c].to_numpy() for p in parts]) for c in "ab")
        name, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        union = Union(len(name))
        union.link(at[: len(a)], at[len(a) :])
        tied = np.flatnonzero(union.label != np.arange(len(name)))
        yield pd.DataFrame({"a": name[tied], "b": name[union.label[tied]]})


def connected_components(edges: DataFrame) -> tuple[DataFrame, str]:
    """edges(a, b), any orientation, nulls and loops ignored -> (node, component) for nodes with a link, component the smallest node.

    Links are contracted to stars in parts of TASK_LINKS at most: one part settles everything. As long
    as there are more, each round also ties neighbours across parts. A round is written to the shared
    folder, so lineage stays short and lost executors cost one round; three numbers of it reach the
    driver, equal when nothing moves any more. Returns the table and its folder, for the caller to remove.
    """
    spark = edges.sparkSession
    now, path = stage(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    before = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count(F.when(F.col("a") < F.col("b"), 1)).alias("up")).first()
        if before == found:
            break
        before = found
        parts = -(-found["n"] // TASK_LINKS)
        if parts > 1:
            dealt = _towards_minimum(now.repartition(parts, "b").mapInPandas(_contracted, "a long, b long"))
        else:
            dealt = now.coalesce(1).mapInPandas(_contracted, "a long, b long")
        after, new = stage(dealt, "edges")
        remove(spark, path)
        now, path = after, new
        if parts <= 1:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), path
