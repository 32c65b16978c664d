"""Interval selection, clipping, splitting and checks. Rows: time, dt, length (and endtime) in one unit."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clustering import _join_small, default_bucket

END = "endtime"


def with_endtime(df: DataFrame, time: str = "time") -> DataFrame:
    """endtime = time + dt * length; the time itself where dt or length is no column."""
    whole = {"dt", "length"} <= set(df.columns)
    return df.withColumn(END, F.col(time) + F.col("dt").cast("long") * F.col("length").cast("long") if whole else F.col(time))


def select_time_range(df: DataFrame, start: int | None = None, end: int | None = None, strict: bool = False, time: str = "time") -> DataFrame:
    """Loose: rows that overlap [start, end); strict: rows inside it. None: open."""
    df = df if END in df.columns else with_endtime(df, time)
    if start is not None:
        df = df.where(F.col(time) >= start) if strict else df.where(F.col(END) > start)
    if end is not None:
        df = df.where(F.col(END) <= end) if strict else df.where(F.col(time) < end)
    return df


def time_index(df: DataFrame, start: int | None = None, end: int | None = None, time: str = "time") -> DataFrame:
    """Rows whose start lies in [start, end)."""
    if start is not None:
        df = df.where(F.col(time) >= start)
    return df if end is None else df.where(F.col(time) < end)


def time_window_closed(df: DataFrame, start: int, end: int, time: str = "timestamp") -> DataFrame:
    return df.where(F.col(time).between(start, end))


def at_time(df: DataFrame, t: int, time: str = "time") -> DataFrame:
    """The last row that starts at or before t, if t lies before its end (equals its start, where there are no lengths)."""
    df = df if END in df.columns else with_endtime(df, time)
    last = df.where(F.col(time) <= t).orderBy(F.col(time).desc(), F.col(END).desc()).limit(1)
    return last.where((F.col(END) > t) | (F.col(time) == t) & (F.col(END) == F.col(time)))


def overlaps(df: DataFrame, start: int, end: int, time: str = "time") -> DataFrame:
    return select_time_range(df, start, end, time=time).limit(1).agg((F.count("*") > 0).alias("overlaps"))


def clip(df: DataFrame, start: int, end: int) -> DataFrame:
    """Overlapping rows with samples outside [start, end) cut off: whole samples only, inwards; empty rows go."""
    df = select_time_range(with_endtime(df), start, end)
    head = F.greatest(F.ceil((F.lit(start) - F.col("time")) / F.col("dt")), F.lit(0)).cast("long")
    tail = F.greatest(F.ceil((F.col(END) - F.lit(end)) / F.col("dt")), F.lit(0)).cast("long")
    df = df.withColumns({"time": F.col("time") + head * F.col("dt"), "length": F.col("length") - head - tail}).where("length > 0")
    return with_endtime(df)


def split_by_time(df: DataFrame, width: int, origin: int | None = None) -> DataFrame:
    """bin for every bin of `width` from the first time that a row overlaps: a row is in all of them."""
    df = df if END in df.columns else with_endtime(df)
    start = origin if origin is not None else df.agg(F.min("time")).first()[0] or 0
    first = F.floor((F.col("time") - start) / width)
    last = F.greatest(F.ceil((F.col(END) - start) / width) - 1, first)
    return df.withColumn("bin", F.explode(F.sequence(first, last)))


def split_by_count(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    from .clustering import number

    return number(df, "__i", order).withColumn("batch", F.floor(F.col("__i") / size)).drop("__i")


def _with_previous(df: DataFrame, order: list[str], values: dict[str, Column], bucket: int | None = None) -> DataFrame:
    """Values of the row before, across bucket borders: lag inside time buckets, the border row from a summary per bucket."""
    b = bucket or default_bucket(df, order[0])
    df = df.withColumn("__b", F.floor(F.col(order[0]) / b)).withColumns({f"__v_{k}": v for k, v in values.items()})
    w = Window.partitionBy("__b").orderBy(*order)
    last = df.groupBy("__b").agg(F.max_by(F.struct(*[f"__v_{k}" for k in values]), F.struct(*order)).alias("__l"))
    last = last.withColumn("__before", F.lag("__l").over(Window.orderBy("__b"))).drop("__l")
    out = _join_small(df, last, ["__b"])
    first = F.row_number().over(w) == 1
    out = out.withColumns({k: F.when(first, F.col(f"__before.__v_{k}")).otherwise(F.lag(f"__v_{k}").over(w)) for k in values})
    return out.drop("__b", "__before", *[f"__v_{k}" for k in values])


def split_by_breaks(df: DataFrame, threshold: int, order: list[str] | None = None, min_size: int = 1, bucket: int | None = None) -> DataFrame:
    """segment: a new one begins where a row starts more than threshold after the end of the row before; segments below min_size go."""
    df = df if END in df.columns else with_endtime(df)
    order = order or ["time"]
    b = bucket or default_bucket(df, order[0])
    df = _with_previous(df, order, {"__prev": F.col(END)}, b).withColumn("__new", (F.col("__prev").isNotNull() & (F.col(order[0]) - F.col("__prev") > threshold)).cast("int")).drop("__prev")
    df = df.withColumn("__b", F.floor(F.col(order[0]) / b))
    carry = df.groupBy("__b").agg(F.sum("__new").alias("n")).withColumn("__off", F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    w = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = _join_small(df, carry, ["__b"]).withColumn("segment", F.sum("__new").over(w) + F.col("__off")).drop("__b", "__new", "__off")
    if min_size > 1:
        big = df.groupBy("segment").count().where(F.col("count") >= min_size).select("segment")
        df = df.join(big, "segment", "left_semi")
    return df


def rechunk_to_boundaries(df: DataFrame, boundaries: list[int]) -> DataFrame:
    """chunk k holds rows that overlap [boundary k-1, boundary k): rows across a boundary are on both sides."""
    df = df if END in df.columns else with_endtime(df)
    edges = sorted(boundaries)
    below = lambda c, strict: F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<bigint>"), lambda e: e < c if strict else e <= c)) if edges else F.lit(0)
    first = below(F.col("time"), False)
    return df.withColumn("chunk", F.explode(F.sequence(first, F.greatest(below(F.col(END), True), first))))


def rechunk(df: DataFrame, target: int, order: list[str], most: int | None = None) -> DataFrame:
    """chunk numbers of target rows each; with `most`, a shorter rest joins the chunk before where both fit."""
    out = split_by_count(df, target, order).withColumnRenamed("batch", "chunk")
    if most and most >= 2:
        sizes = out.groupBy("chunk").count()
        last = sizes.agg(F.max("chunk").alias("c"), F.max_by("count", "chunk").alias("n")).first()
        if last["c"] and last["n"] + target <= most and last["n"] < target:
            out = out.withColumn("chunk", F.least("chunk", F.lit(last["c"] - 1)))
    return out


def split_at(df: DataFrame, t: int, time: str = "time") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(time) < t), df.where(F.col(time) >= t)


def time_extent(df: DataFrame, time: str = "time") -> DataFrame:
    df = df if END in df.columns else with_endtime(df, time)
    return df.agg(F.coalesce(F.min(time), F.lit(0)).alias("start"), F.coalesce(F.max(END), F.lit(0)).alias("end"))


def check_monotonic(df: DataFrame, position: str, time: str = "time", strict: bool = False) -> DataFrame:
    """One row: violations, position of the first, least and largest step, in the order of a whole-number position."""
    d = _with_previous(df, [position], {"__p": F.col(time)}).withColumn("__d", F.col(time) - F.col("__p"))
    bad = F.col("__d") <= 0 if strict else F.col("__d") < 0
    return d.agg(F.count(F.when(bad, 1)).alias("violations"), F.min(F.when(bad, F.col(position))).alias("first_violation"), F.min("__d").alias("min_step"), F.max("__d").alias("max_step"))


def check_no_overlap(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row: how many rows start before the row before them, in time, has ended, and by how much at most."""
    df = df if END in df.columns else with_endtime(df)
    d = _with_previous(df, order or ["time"], {"__p": F.col(END)}).withColumn("__o", F.col("__p") - F.col((order or ["time"])[0]))
    return d.agg(F.count(F.when(F.col("__o") > 0, 1)).alias("overlaps"), F.max(F.when(F.col("__o") > 0, F.col("__o"))).alias("largest"))


def check_sorted(df: DataFrame, position: str, time: str = "time") -> DataFrame:
    """One row: rows before their predecessor by position, rows that start before their predecessor in time has ended, and whether there are neither."""
    steps = check_monotonic(df, position, time).select(F.col("violations").alias("unsorted"))
    both = steps.crossJoin(check_no_overlap(df, [time, position]).select(F.col("overlaps").alias("overlapping")))  # one row each
    return both.withColumn("ok", (F.col("unsorted") == 0) & (F.col("overlapping") == 0))


def first_occurrences(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of each value of keys by a whole-number position; the others go."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(row, position).alias("__r")).select("__r.*")


def check_endtime(df: DataFrame, tolerance: int = 0) -> DataFrame:
    off = F.abs(F.col(END) - (F.col("time") + F.col("dt").cast("long") * F.col("length").cast("long")))
    return df.agg(F.count(F.when(off > tolerance, 1)).alias("violations"), F.max(off).alias("largest"))


def check_boundaries(df: DataFrame, start: int, end: int) -> DataFrame:
    df = df if END in df.columns else with_endtime(df)
    return df.agg(F.count(F.when(F.col("time") < start, 1)).alias("before_start"), F.count(F.when(F.col(END) > end, 1)).alias("after_end"))


def check_continuity(chunks: DataFrame) -> DataFrame:
    """chunks(start, end) -> gap rows between neighbours: positive gaps, negative overlaps."""
    d = _with_previous(chunks, ["start"], {"previous_end": F.col("end")})
    return d.where(F.col("start") != F.col("previous_end")).select("previous_end", "start", (F.col("start") - F.col("previous_end")).alias("gap"))


def sort_records(df: DataFrame, order: tuple[str, ...] = ("timestamp", "pid", "board", "channel", "record_id")) -> DataFrame:
    """record_id numbered anew in global order; the old one stays as source_id."""
    from .clustering import number

    keys = [c for c in order if c in df.columns]
    out = number(df, "__new", keys)
    return (out.withColumnRenamed("record_id", "source_id") if "record_id" in df.columns else out).withColumnRenamed("__new", "record_id")


def merge_sorted(*frames: DataFrame, order: list[str]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(*order)


def as_of(points: DataFrame, rows: DataFrame, point: str = "t", time: str = "time", order: list[str] | None = None, bucket: int | None = None) -> DataFrame:
    """points, each with `found`: the last of rows (as a struct) that starts at or before it, null where there is none, and
    `inside`: whether the point lies before that row's end (at its start, where it has no length).

    Both sides are dealt by time buckets; the last row of a bucket is carried to the buckets after it by one
    summary row each, so nothing is joined by range. Ties in time go to the later end, then to `order`. Rows
    without a time are not found, and a point without one finds nothing.
    """
    rows = (rows if END in rows.columns else with_endtime(rows, time)).where(F.col(time).isNotNull())
    b = bucket or default_bucket(rows, time)
    keys = [time, END, *(order or [])]
    row, asked = F.struct(*[F.col(c) for c in rows.columns]), F.struct(*[F.col(c) for c in points.columns])
    stands = rows.select(F.col(time).cast("long").alias("__t"), F.lit(0).alias("__kind"), F.struct(*keys).alias("__key"), row.alias("__row"))
    asks = points.select(F.col(point).cast("long").alias("__t"), F.lit(1).alias("__kind"), asked.alias("__ask"))
    both = stands.unionByName(asks, allowMissingColumns=True).withColumn("__b", F.floor(F.col("__t") / b))
    here = F.last("__row", ignorenulls=True).over(Window.partitionBy("__b").orderBy("__t", "__kind", "__key").rowsBetween(Window.unboundedPreceding, 0))
    last = both.groupBy("__b").agg(F.max_by("__row", F.when(F.col("__kind") == 0, F.col("__key"))).alias("__l"))
    before = F.last("__l", ignorenulls=True).over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    out = _join_small(both.withColumn("__here", here).where("__kind = 1"), last.select("__b", before.alias("__carry")), ["__b"])
    out = out.select("__ask.*", F.coalesce("__here", "__carry").alias("found"))
    t, start, end = F.col(point), F.col("found")[time], F.col("found")[END]
    return out.withColumn("inside", F.coalesce((t < end) | (t == start) & (end == start), F.lit(False)))


def between_instants(df: DataFrame, epoch_ns: int, start=None, end=None, ticks_per_ns: float = 1, time: str = "time") -> DataFrame:
    """Rows that start in [start, end), instants given as aware datetimes; the rows' time counts ticks from epoch_ns."""

    def ticks(at):
        if at is None:
            return None
        whole = (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) * 1000
        return int((whole - epoch_ns) * ticks_per_ns)

    return time_index(df, ticks(start), ticks(end), time)


def by_hardware_channel(df: DataFrame) -> dict[tuple[int, int], DataFrame]:
    """(board, channel) -> its rows, lazily; what reaches the driver is one row per channel."""
    found = df.select("board", "channel").distinct().orderBy("board", "channel").collect()
    return {(r.board, r.channel): df.where(F.col("board").eqNullSafe(r.board) & F.col("channel").eqNullSafe(r.channel)) for r in found}


def by_channel(df: DataFrame) -> dict[int, DataFrame]:
    """channel -> its rows, for data of board 0 alone; any other board is an error."""
    split = by_hardware_channel(df)
    if any(board != 0 for board, _ in split):
        raise ValueError("rows of other boards than 0: split by board and channel")
    return {channel: rows for (_, channel), rows in split.items()}
