"""Tables cut into chunks with a main range and a halo, as streams of chunks are: built, checked, selected, computed on.

A chunk is named by (segment, chunk): segments lie between breaks in time, chunks inside one hold about
`size` rows each. What is known of a chunk is one small row, joined to its rows by equality.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clustering import _join_small, default_bucket
from .intervals import END, clip, split_by_breaks, with_endtime

KEYS = ["segment", "chunk"]
#: Columns that chunk_stream adds.
ADDED = [*KEYS, "main_start", "main_end", "is_main"]


def chunk_stream(df: DataFrame, size: int = 50_000, threshold: int | None = None, before: int = 0, after: int = 0, order: tuple[str, ...] = ("time",), bucket: int | None = None) -> DataFrame:
    """Rows with segment, chunk, main_start, main_end, is_main; a row is once main and again in each halo that it lies in.

    A segment ends where a row starts more than `threshold` after the end of the row before (None: one
    segment). Chunks hold `size` rows of a segment in order; rows that start together stay together, in
    the later chunk. The main range is [start of the first row, start of the next chunk), or up to the
    largest end where there is none. The halo holds rows of the segment that start at most `before` ahead
    of the main range or less than `after` behind its end. bucket: ticks of a time bucket; default by the
    density of rows.
    """
    if size < 1 or before < 0 or after < 0:
        raise ValueError("size is at least 1, before and after are not negative")
    time, order = order[0], list(order)
    df = df if END in df.columns else with_endtime(df, time)
    b = bucket or default_bucket(df, time)
    rows = df.withColumn("segment", F.lit(0).cast("long")) if threshold is None else split_by_breaks(df, threshold, order, bucket=b)
    # Rows up to each start: those of earlier buckets of the segment, from a summary, and those of its own.
    rows = rows.withColumn("__b", F.floor(F.col(time) / b))
    per = Window.partitionBy("segment")
    earlier = F.coalesce(F.sum("__n").over(per.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = rows.groupBy("segment", "__b").agg(F.count("*").alias("__n")).select("segment", "__b", earlier.alias("__earlier"))
    here = F.count("*").over(Window.partitionBy("segment", "__b").orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = _join_small(rows, carry, ["segment", "__b"]).withColumn("chunk", F.floor((F.col("__earlier") + here - 1) / size)).drop("__b", "__earlier")
    spans = rows.groupBy(*KEYS).agg(F.min(time).alias("main_start"), F.greatest(F.max(END), F.max(time) + 1).alias("__end"))
    ranges = spans.select(*KEYS, "main_start", F.coalesce(F.lead("main_start").over(per.orderBy("chunk")), F.max("__end").over(per)).alias("main_end"))
    out = _join_small(rows, ranges, KEYS).withColumn("is_main", F.lit(True))
    if not before and not after:
        return out
    return out.unionByName(_halo(rows, ranges, before, after, time))


def _halo(rows: DataFrame, ranges: DataFrame, before: int, after: int, time: str) -> DataFrame:
    """Rows in the zones ahead of and behind main ranges, met by (segment, piece of time): zones are as long as a piece at most."""
    piece = max(before, after)
    zones = [F.struct(F.col(at).alias("__from"), F.col(to).alias("__to")) for at, to, wide in (("__early", "main_start", before), ("main_end", "__late", after)) if wide]
    z = ranges.withColumns({"__early": F.col("main_start") - before, "__late": F.col("main_end") + after}).select(*KEYS, "main_start", "main_end", F.explode(F.array(*zones)).alias("__z"))
    z = z.select(F.col("segment").alias("__s"), F.col("chunk").alias("__c"), "main_start", "main_end", "__z.*").withColumn("__p", F.explode(F.sequence(F.floor(F.col("__from") / piece), F.floor((F.col("__to") - 1) / piece))))
    near = rows.withColumn("__q", F.floor(F.col(time) / piece))
    hit = near.join(z, (F.col("segment") == F.col("__s")) & (F.col("__q") == F.col("__p")) & (F.col(time) >= F.col("__from")) & (F.col(time) < F.col("__to")))
    return hit.drop("segment", "chunk", "__q", "__p", "__from", "__to").withColumnsRenamed({"__s": "segment", "__c": "chunk"}).withColumn("is_main", F.lit(False))


def check_chunks(chunks: DataFrame, ends: bool = False, time: str = "time") -> DataFrame:
    """The same rows; one that is main and starts outside its main range (or, with ends, ends behind it) fails the job."""
    bad = (F.col(time) < F.col("main_start")) | (F.col(time) >= F.col("main_end"))
    if ends:
        bad = bad | (F.col(END) > F.col("main_end"))
    text = F.concat(F.lit("outside the main range of segment "), F.col("segment"), F.lit(", chunk "), F.col("chunk"), F.lit(": a row at "), F.col(time))
    return chunks.where(F.when(F.col("is_main") & bad, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


def stream_range(chunks: DataFrame, start: int | None = None, end: int | None = None, cut: bool = True) -> DataFrame:
    """Chunks whose main range overlaps [start, end); with cut, their rows clipped to it (both limits given, rows with dt and length)."""
    out = chunks if start is None else chunks.where(F.col("main_end") > start)
    out = out if end is None else out.where(F.col("main_start") < end)
    return clip(out, start, end) if cut and start is not None and end is not None else out


def map_chunks(chunks: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, time: str = "time") -> DataFrame:
    """function(rows of a chunk in time, halo included) -> its results, with segment and chunk; results that start outside the main range go.

    schema: the columns of the results, as text. A chunk is a task's unit, so its size bounds memory. A
    failing chunk fails the job. Rows come in no order: sort by (segment, chunk) where one is needed.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        found = function(pdf.sort_values(time, kind="stable").drop(columns=[c for c in ADDED if c != "is_main"]).reset_index(drop=True))
        if time in found.columns:
            found = found[(found[time] >= first["main_start"]) & (found[time] < first["main_end"])]
        return found.assign(segment=first["segment"], chunk=first["chunk"])

    return chunks.groupBy(*KEYS).applyInPandas(one, f"{schema}, segment long, chunk long")
