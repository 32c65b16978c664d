"""Ordered clustering in time: chained, anchored and width-capped groups, and what is made of them.

The order is global, but no task sees more than a bucket of it: gaps are found inside time buckets, and
one summary row per bucket carries the running end across their borders. Anchored clusters, which depend
on their own start, go through buckets by what each would let out for what comes in. Capped ones are
walked inside the stretches between gaps, many stretches to a task. The summary rows, one for some
200,000 rows, meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANNEL = ["board", "channel"]


def default_bucket(df: DataFrame, start: str, rows_per_bucket: int = 200_000) -> int:
    r = df.agg(F.min(start).alias("lo"), F.max(start).alias("hi"), F.count("*").alias("n")).first()
    return max(1, (r["hi"] - r["lo"]) * rows_per_bucket // max(1, r["n"]) + 1) if r["n"] else 1


def chain(df: DataFrame, start: str, end: str, gap: int, keys: list[str] | None = None, order: list[str] | None = None, bucket: int | None = None, out: str = "chain_start") -> DataFrame:
    """Adds the start of the chain each row is in: a row joins while its start is within `gap` of the largest end so far (per keys).

    gap < 0 is an error. Rows are ordered by start, then `order`. bucket: ticks of a time bucket; default
    by the density of rows.
    """
    if gap < 0:
        raise ValueError("a gap can't be negative")
    keys = keys or []
    b = bucket or default_bucket(df, start)
    df = df.withColumn("__b", F.floor(F.col(start) / b))
    w = Window.partitionBy(*keys, "__b").orderBy(start, *(order or []))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, "__b").agg(F.max(end).alias("__m")).withColumn("__carry", F.max("__m").over(over)).drop("__m")
    flagged = _join_small(df, ends, [*keys, "__b"]).withColumn("__prev", F.greatest(F.max(end).over(before), F.col("__carry")))
    flagged = flagged.withColumn("__new", F.col("__prev").isNull() | (F.col(start) > F.col("__prev") + gap))
    latest = flagged.groupBy(*keys, "__b").agg(F.max(F.when(F.col("__new"), F.col(start))).alias("__s")).withColumn("__last", F.max("__s").over(over)).drop("__s")
    here = F.max(F.when(F.col("__new"), F.col(start))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _join_small(flagged, latest, [*keys, "__b"]).withColumn(out, F.coalesce(here, "__last")).drop("__b", "__prev", "__carry", "__new", "__last")


def _join_small(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    renamed = small.withColumnsRenamed({k: f"{k}__r" for k in on})
    cond = [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in on]
    test = cond[0]
    for c in cond[1:]:
        test = test & c
    return df.join(renamed, test, "left").drop(*[f"{k}__r" for k in on])


def _walk(df: DataFrame, keys: list[str], segment: str, order: list[str], step, columns: list[str], out: str) -> DataFrame:
    """Rows of a segment meet in one task, in order; step(values, state) -> (cluster starts, state) runs over batches."""
    schema = df.withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in batches:
            if len(pdf):
                pdf = pdf.copy()
                pdf[out], state = step(pdf[[*keys, segment, *columns]], state)
            else:
                pdf[out] = pd.Series(dtype="int64")
            yield pdf

    return df.repartition(*keys, segment).sortWithinPartitions(*keys, segment, *order).mapInPandas(run, schema)


def _jumps(t: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted times, if a cluster began there: where the last cluster after it begins, and how many begin in between, by doubling of jumps."""
    n = len(t)
    after = np.searchsorted(t, t + window, side="right")
    end, count = np.where(after < n, after, np.arange(n)), (after < n).astype(np.int64)
    while True:
        further = end[end]
        if (further == end).all():
            return end, count
        end, count = further, count + count[end]


def anchored(df: DataFrame, window: int, time: str = "timestamp", keys: list[str] | None = None, bucket: int | None = None) -> DataFrame:
    """Adds `anchor`, the first time of the row's cluster, which holds all rows up to anchor + window, the next row beyond being the next anchor; and `anchor_index`, counting clusters from 0 in time (per keys).

    A bucket of time doesn't know its first anchor, but what leaves it for each that it could be: a few
    steps, since later entries can't leave earlier. One row of them per bucket is followed through in
    time; then all buckets are labelled side by side, at any rate of rows and with no gap between them.
    """
    keys = keys or []
    b = bucket or default_bucket(df, time)
    df = df.withColumn("__b", F.floor(F.col(time) / b).cast("long"))
    kinds = dict(df.dtypes)
    named = "".join(f"`{k}` {kinds[k]}, " for k in [*keys, "__b"])

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf[time].to_numpy())
        end, count = _jumps(t, window)
        some = min(len(t), 1 + int(np.searchsorted(t, int(pdf["__b"].iloc[0]) * b + window, side="right")))
        out, count = t[end[:some]], count[:some]
        last = np.append(np.flatnonzero((out[1:] != out[:-1]) | (count[1:] != count[:-1])), some - 1)
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in [*keys, "__b"]}, "upto": [t[last]], "out": [out[last]], "count": [count[last] + 1]})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__b")
        anchor, number, rows = None, 0, []
        for upto, out, count in zip(pdf["upto"], pdf["out"], pdf["count"], strict=True):
            rows.append((anchor, number))
            k = int(np.searchsorted(upto, anchor + window, side="right")) if anchor is not None else 0
            if k < len(upto):
                anchor, number = int(out[k]), number + int(count[k])
        return pd.DataFrame({**{k: pdf[k] for k in [*keys, "__b"]}, "__in": pd.array([a for a, _ in rows], "Int64"), "__n": [n for _, n in rows]}, index=pdf.index)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        t, entered, number = pdf[time].to_numpy(), pdf["__in"].iloc[0], int(pdf["__n"].iloc[0])
        after = np.searchsorted(t, t + window, side="right").tolist()
        i = 0 if pd.isna(entered) else int(np.searchsorted(t, int(entered) + window, side="right"))
        starts = [] if i == 0 else [0]
        values = [] if i == 0 else [int(entered)]
        while i < len(t):
            starts.append(i)
            values.append(t[i])
            i = after[i]
        size = np.diff(np.append(starts, len(t)))
        first = number - (1 if values and starts[0] == 0 and not pd.isna(entered) and values[0] == entered and t[0] <= entered + window else 0)
        out = pdf.drop(columns=["__in", "__n", "__b"])
        out["anchor"], out["anchor_index"] = np.repeat(np.array(values, np.int64), size), np.repeat(first + np.arange(len(values)), size)
        return out

    summary = df.select(*keys, time, "__b").groupBy(*keys, "__b").applyInPandas(steps, named + "upto array<long>, out array<long>, count array<long>")
    entered = summary.withColumn("__one", F.lit(0)).groupBy(*(keys or ["__one"])).applyInPandas(lambda pdf: follow(pdf), named + "__in long, __n long")
    schema = df.drop("__b").withColumns({"anchor": F.lit(0).cast("long"), "anchor_index": F.lit(0).cast("long")}).schema
    return _join_small(df, entered, [*keys, "__b"]).groupBy(*keys, "__b").applyInPandas(label, schema)


def group_events(hits: DataFrame, window_ns: float = 100, bucket: int | None = None, tick_per_ns: int = 1000) -> DataFrame:
    """hits(timestamp, channel, area, height [, record_id]) -> multi-channel events.

    Anchored clusters over all channels. Members are listed by channel, then time, then record; t_min and
    t_max are the first and last timestamps of that list (so dt/ns may be negative), ts_min and ts_max
    those in time. event_id counts from 0 in time.
    """
    needed = [c for c in ("timestamp", "channel", "record_id", "area", "height") if c in hits.columns]
    grouped = anchored(hits.select(*needed), int(window_ns * tick_per_ns), "timestamp", bucket=bucket)
    member = F.struct("channel", "timestamp", *(["record_id"] if "record_id" in hits.columns else []), "area", "height")
    ev = grouped.groupBy(F.col("anchor_index").alias("event_id")).agg(F.array_sort(F.collect_list(member)).alias("m"), F.min("timestamp").alias("ts_min"), F.max("timestamp").alias("ts_max"))
    pick = lambda f: F.transform("m", lambda x: x[f])
    t_min, t_max = F.get("m", 0)["timestamp"], F.element_at("m", -1)["timestamp"]
    return ev.select("event_id", t_min.alias("t_min"), t_max.alias("t_max"), ((t_max - t_min) / tick_per_ns).alias("dt/ns"), F.size("m").alias("n_hits"), pick("channel").alias("channels"), pick("area").alias("areas"), pick("height").alias("heights"), pick("timestamp").alias("timestamps"), "ts_min", "ts_max")


def number(df: DataFrame, name: str, order: list[str], rows_per_bucket: int = 200_000, bucket: int | None = None) -> DataFrame:
    """0-based numbers in the order of `order` (the first a whole number), ranked inside buckets and offset by their counts."""
    b = bucket or default_bucket(df, order[0], rows_per_bucket)
    df = df.withColumn("__b", F.floor(F.col(order[0]) / b))
    counts = df.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__off", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1
    return _join_small(df, counts, ["__b"]).withColumn(name, (rank + F.col("__off")).cast("long")).drop("__b", "__off")


def pair_events(events: DataFrame, window_ns: float = 100, n_channels: int = 2, first_channel: int = 6, tick_per_ns: int = 1000) -> DataFrame:
    """Events with |span| rule dt/ns <= window, delta_t, and area/height by position in the lists under names that count from first_channel."""
    ts = F.col("timestamps")
    out = events.where(F.col("`dt/ns`") <= window_ns).withColumn("delta_t", (F.element_at(ts, -1) - F.get(ts, 0)) / tick_per_ns)
    nan = F.lit(float("nan"))
    return out.withColumns({f"{k}_ch{first_channel + i}": F.coalesce(F.get(f"{k}s", i).cast("double"), nan) for i in range(n_channels) for k in ("area", "height")})


def pair_events_with(events: DataFrame, strategy: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """The same columns on the events that a rule of one's own leaves; its own window, if any, is the only one."""
    return pair_events(strategy(events), **({"window_ns": float("inf")} | options))


def contains_channels(events: DataFrame, targets: list[int]) -> DataFrame:
    """Events in which all target channels take part; no targets: all events."""
    return events.where(F.size(F.array_except(F.array(*[F.lit(t) for t in targets]).cast("array<bigint>"), F.col("channels").cast("array<bigint>"))) == 0) if targets else events


def channel_attribute(channels: list[int], attribute: str = "areas", prefix: str = "ch") -> list[Column]:
    """Per channel, the attribute at the channel's first place in the event; null where it isn't there."""
    return [F.get(attribute, F.array_position(F.col("channels").cast("array<bigint>"), F.lit(c).cast("long")).cast("int") - 1).alias(f"{prefix}{c}") for c in channels]


def absolute_window(hits: DataFrame, start: str = "edge_start", end: str = "edge_end") -> DataFrame:
    """abs_start and abs_end in ps, in whole-number arithmetic."""
    at = lambda e: F.col("timestamp") + (F.col(e).cast("long") - F.col("position").cast("long")) * F.col("dt").cast("long") * 1000
    return hits.withColumns({"abs_start": at(start), "abs_end": at(end)})


def merge_clusters(hits: DataFrame, merge_gap_ns: float = 0, max_width_ns: float = 10_000, bucket: int | None = None) -> DataFrame:
    """hits(hit_index, timestamp, position, edge_start, edge_end, dt, board, channel, ...) -> hits with cluster_start.

    Per channel, in order of absolute start: a hit joins the open cluster if the gap is positive and
    allows it, dt is that of the last member and the whole stays within the width. A gap of 0 merges none.
    """
    df = absolute_window(hits)
    if merge_gap_ns <= 0:
        return df.withColumn("cluster_first", F.col("hit_index"))
    gap, cap = int(merge_gap_ns * 1000), int(max_width_ns * 1000)
    df = chain(df, "abs_start", "abs_end", gap, CHANNEL, ["hit_index"], bucket, "__segment")

    def step(pdf: pd.DataFrame, state):
        rows, out = pdf.itertuples(index=False, name=None), []
        for board, channel, segment, s, e, dt, i in rows:
            if state and state[:3] == (board, channel, segment) and dt == state[5] and s - state[4] <= gap and max(state[4], e) - state[3] <= cap:
                state = (board, channel, segment, state[3], max(state[4], e), dt, state[6])
            else:
                state = (board, channel, segment, s, e, dt, i)
            out.append(state[6])
        return np.array(out, np.int64), state

    return _walk(df, CHANNEL, "__segment", ["abs_start", "hit_index"], step, ["abs_start", "abs_end", "dt", "hit_index"], "cluster_first").drop("__segment")


def cluster_numbers(clustered: DataFrame) -> DataFrame:
    """cluster_first -> cluster_index: by channel, then time. Numbered over one row per cluster, ranked per channel."""
    heads = clustered.where("cluster_first = hit_index").select("board", "channel", "abs_start", "cluster_first")
    per = heads.groupBy(*CHANNEL).agg(F.count("*").alias("n")).withColumn("off", F.coalesce(F.sum("n").over(Window.orderBy(*CHANNEL).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy(*CHANNEL).orderBy("abs_start", "cluster_first")) - 1
    return heads.join(per, CHANNEL).select("cluster_first", (rank + F.col("off")).cast("long").alias("cluster_index"))


def hit_merge_clusters(clustered: DataFrame) -> DataFrame:
    """The bridge cluster_index, hit_index."""
    return clustered.select("cluster_first", "hit_index").join(cluster_numbers(clustered), "cluster_first").select("cluster_index", "hit_index")


def merged_hits(clustered: DataFrame) -> DataFrame:
    """One row per cluster: values of its highest hit (ties: earliest), summed integral, joint window (-1 where records differ), component offset and count."""
    one = F.struct("height", (-F.col("timestamp")).alias("t"), (-F.col("hit_index")).alias("i"))
    kept = F.struct("position", "height", "dt", "rise_time", "fall_time", "timestamp", "board", "channel", "record_id")
    agg = clustered.groupBy("cluster_first").agg(F.max_by(kept, one).alias("k"), F.sum("integral").alias("integral"), F.min("edge_start").alias("s"), F.max("edge_end").alias("e"), (F.min("record_id") == F.max("record_id")).alias("same"), F.count("*").cast("int").alias("component_count"))
    start, end = (F.when(F.col("same"), F.col(c)).otherwise(-1) for c in "se")
    df = agg.join(cluster_numbers(clustered), "cluster_first")
    df = df.select("cluster_index", "k.*", "integral", start.alias("sample_start"), end.alias("sample_end"), F.when(F.col("same"), F.col("e") - F.col("s")).otherwise(-1).alias("width"), "component_count")
    b = df.withColumn("__b", F.floor(F.col("cluster_index") / 200_000))
    carry = b.groupBy("__b").agg(F.sum("component_count").alias("n")).withColumn("__off", F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.coalesce(F.sum("component_count").over(Window.partitionBy("__b").orderBy("cluster_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _join_small(b, carry, ["__b"]).withColumn("component_offset", (within + F.col("__off")).cast("long")).drop("__b", "__off")


def merged_components(clustered: DataFrame) -> DataFrame:
    return hit_merge_clusters(clustered).withColumnRenamed("cluster_index", "merged_index")


def repair_windows(merged: DataFrame, components: DataFrame, hits: DataFrame) -> DataFrame:
    """Absolute windows of merged hits; where the sample window is -1, the extent of the component hits."""
    parts = components.join(absolute_window(hits).select("hit_index", "abs_start", "abs_end"), "hit_index").groupBy("merged_index").agg(F.min("abs_start").alias("__s"), F.max("abs_end").alias("__e"))
    df = absolute_window(merged, "sample_start", "sample_end").join(parts, F.col("cluster_index") == F.col("merged_index"), "left").drop("merged_index")
    bad = (F.col("sample_start") < 0) | (F.col("sample_end") < 0)
    missing = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("a merged hit has no components")).cast("long"))
    return df.withColumns({"abs_start": F.when(bad, missing("__s")).otherwise(F.col("abs_start")), "abs_end": F.when(bad, missing("__e")).otherwise(F.col("abs_end"))}).drop("__s", "__e")


def group_hit_windows(hits: DataFrame, window_ns: float = 100, bucket: int | None = None) -> DataFrame:
    """hits(abs_start, abs_end, dt, board, channel, timestamp, record_id, height, integral, ...) -> chained events over all channels, members by (board, channel, dt, start, time, record)."""
    if window_ns < 0:
        raise ValueError("a window can't be negative")
    bucket = bucket or default_bucket(hits, "abs_start")
    df = chain(hits, "abs_start", "abs_end", int(window_ns * 1000), None, ["dt", "timestamp", "record_id"], bucket, "chain_start")
    start, end = ("sample_start", "sample_end") if "sample_start" in hits.columns else ("edge_start", "edge_end")
    member = F.struct("board", "channel", "dt", "abs_start", "timestamp", "record_id", "height", "integral", F.col(start).alias("sample_start"), F.col(end).alias("sample_end"))
    ev = df.groupBy("chain_start").agg(F.array_sort(F.collect_list(member)).alias("m"), F.min("abs_start").alias("t_min"), F.max("abs_end").alias("t_max"))
    lists = {"dt": "dt", "boards": "board", "channels": "channel", "heights": "height", "integrals": "integral", "timestamps": "timestamp", "record_ids": "record_id", "sample_starts": "sample_start", "sample_ends": "sample_end"}
    at = lambda f: F.transform("m", lambda x: x[f])
    return number(ev, "event_id", ["t_min"], bucket=bucket).select("event_id", "t_min", "t_max", ((F.col("t_max") - F.col("t_min")) / 1000).alias("dt/ns"), F.size("m").alias("n_hits"), *[at(f).alias(n) for n, f in lists.items()])
