"""Per-record features, charge quantiles, widths, calibration and classification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import waves as W

CHANNEL = ["board", "channel"]


def channel_table(df: DataFrame, values: Mapping[tuple[int, int], Mapping[str, object]], types: Mapping[str, str]) -> DataFrame:
    """A small table board, channel and one column per type; absent values are null."""
    schema = "board int, channel int" + "".join(f", {n} {t}" for n, t in types.items())
    return df.sparkSession.createDataFrame([(b, c, *[v.get(n) for n in types]) for (b, c), v in values.items()], schema)


def with_channel_values(df: DataFrame, values: Mapping[tuple[int, int], Mapping[str, object]], types: Mapping[str, str]) -> DataFrame:
    """A left lookup by hardware channel. The table holds one row per channel; Spark broadcasts it by its size."""
    t = channel_table(df, values, types).withColumnsRenamed({"board": "__b", "channel": "__c"})
    return df.join(t, (F.col("board") == F.col("__b")) & (F.col("channel") == F.col("__c")), "left").drop("__b", "__c")


def layered_values(channels: list[tuple[int, int]], defaults: Mapping[str, object] | None = None, groups: Sequence[tuple[Sequence[tuple[int, int]], Mapping[str, object]]] = (), by_channel: Mapping[tuple[int, int], Mapping[str, object]] | None = None, run: Mapping[tuple[int, int], Mapping[str, object]] | None = None) -> dict[tuple[int, int], dict[str, object]]:
    """Values of each channel: defaults, then those of the groups that it is in (later ones win), then its own, then the run's."""
    out = {}
    for c in channels:
        layers = [defaults or {}, *(values for members, values in groups if c in set(map(tuple, members))), (by_channel or {}).get(c, {}), (run or {}).get(c, {})]
        out[c] = {k: v for layer in layers for k, v in layer.items()}
    return out


def map_channels(rows: DataFrame, mapping: Mapping[tuple[int, int], int]) -> DataFrame:
    """Rows with logical_channel: where the mapping puts (board, channel), -1 where it doesn't."""
    df = with_channel_values(rows, {k: {"__to": int(v)} for k, v in mapping.items()}, {"__to": "int"})
    return df.withColumn("logical_channel", F.coalesce("__to", F.lit(-1))).drop("__to")


def structure_waveforms(rows: DataFrame, baseline_start: int = 0, baseline_end: int = 40, dt_ns: int = 2, polarity: Mapping[tuple[int, int], str] | None = None) -> DataFrame:
    """rows(board, channel, timestamp, wave) -> waveform rows: baseline by window mean, dt in ns, polarity by channel (unknown where none is known)."""
    known = {k: {"polarity": v if v in ("positive", "negative") else "unknown"} for k, v in (polarity or {}).items()}
    df = with_channel_values(rows.drop("polarity"), known, {"polarity": "string"}) if known else rows.withColumn("polarity", F.lit("unknown"))
    return df.select(
        W.mean(F.col("wave"), baseline_start, baseline_end).alias("baseline"), F.lit(W.NAN).alias("baseline_upstream"), F.coalesce("polarity", F.lit("unknown")).alias("polarity"), "timestamp", *(["record_id"] if "record_id" in rows.columns else []),
        F.lit(dt_ns).alias("dt"), F.size("wave").alias("event_length"), "board", "channel", "wave",
    )


def basic_features(waveforms: DataFrame, height_range: tuple[int, int | None] = (40, 90), area_range: tuple[int, int | None] = (0, None), fixed_baseline: Mapping[tuple[int, int], float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """height, amp, area, max_abs_diff per record; empty windows give 0. fixed_baseline replaces a channel's baseline."""
    df = waveforms
    base: Column = F.col("baseline")
    if fixed_baseline:
        df = with_channel_values(df, {k: {"__fixed": float(v)} for k, v in fixed_baseline.items()}, {"__fixed": "double"})
        base = F.coalesce("__fixed", "baseline")
    wave, sign = F.col("wave"), F.col("polarity")
    return df.select(
        W.height(wave, base, sign, *height_range).alias("height"), W.amplitude(wave, *height_range).alias("amp"), W.area(wave, base, sign, *area_range).alias("area"), W.max_abs_diff(wave).alias("max_abs_diff"),
        "timestamp", "board", "channel", F.col("record_id").alias("event_index"), *keep,
    )


def calibrate(df: DataFrame, gain: Mapping[tuple[int, int], float]) -> DataFrame:
    """area_pe and height_pe: value over the channel's gain; NaN where there is none above 0."""
    df = with_channel_values(df, {k: {"__gain": float(v)} for k, v in gain.items()}, {"__gain": "double"})
    per = lambda c: F.when(F.col("__gain") > 0, F.col(c) / F.col("__gain")).otherwise(F.lit(W.NAN))
    return df.withColumns({"area_pe": per("area"), "height_pe": per("height")}).drop("__gain")


def record_frame(waveforms: DataFrame, gain: Mapping[tuple[int, int], float] | None = None, **options) -> DataFrame:
    """timestamp, record_id, area, height, amp, max_abs_diff, board, channel, and calibrated values where gains are given: one projection, no join."""
    df = basic_features(waveforms, **options).select("timestamp", F.col("event_index").alias("record_id"), "area", "height", "amp", "max_abs_diff", "board", "channel")
    return calibrate(df, gain) if gain else df


def width_integral(waveforms: DataFrame, q_low: float = 0.1, q_high: float = 0.9) -> DataFrame:
    """Times at which the running charge of the positive signal reaches two shares of the whole, and their distance."""
    if not 0 < q_low < q_high < 1:
        raise ValueError("0 < q_low < q_high < 1")
    charge = F.transform(W.pulse(F.col("wave"), F.col("baseline"), F.col("polarity")), lambda x: F.when(x > 0, x).otherwise(0.0))
    df = waveforms.withColumn("__x", charge).withColumn("q_total", W.total(F.col("__x"))).withColumn("__sums", W.cumulative(F.col("__x")))
    ok = (F.col("q_total") > 0) & ~F.isnan("q_total") & (F.col("q_total") < float("inf"))
    at = lambda q: F.when(ok, W.first_at_least(F.col("__sums"), F.col("q_total") * q)).otherwise(0)
    df = df.withColumn("__lo", at(q_low)).withColumn("__hi", at(q_high))
    samples = {"t_low_samples": F.col("__lo"), "t_high_samples": F.col("__hi"), "width_samples": F.greatest(F.col("__hi") - F.col("__lo"), F.lit(0))}
    return df.select(*[(v * F.col("dt")).cast("double").alias(k.removesuffix("_samples")) for k, v in samples.items()], *[v.cast("double").alias(k) for k, v in samples.items()], F.when(ok, F.col("q_total")).otherwise(0.0).alias("q_total"), "timestamp", "board", "channel", F.col("record_id").alias("event_index"))


def pulse_widths(hits: DataFrame, waveforms: DataFrame, rate_ghz: float = 0.5, rise_low: float = 0.1, rise_high: float = 0.9, fall_high: float = 0.9, fall_low: float = 0.1, interpolate: bool = True, baseline_samples: int = 50, polarity_aware: bool = False) -> DataFrame:
    """Rise, fall and total width of each hit's record around its position, from crossings of shares of the peak.

    Baseline is the mean of the first samples; hits beyond the record or with no positive peak go. The
    waveform side of the join is not exploded: crossings are found in the array.
    """
    # Record-level values once per waveform, then one equi-join on the record.
    sign = F.when(F.col("polarity") == "negative", -1.0).otherwise(1.0) if polarity_aware else F.lit(1.0)
    base = waveforms.withColumn("__base", W.mean(F.col("wave"), 0, baseline_samples)).select("record_id", F.transform("wave", lambda x: (x.cast("double") - F.col("__base")) * sign).alias("__w"))
    df = hits.join(base, "record_id").where("position >= 0 and position < size(__w)").withColumn("__peak", F.get("__w", F.col("position").cast("int"))).where("__peak > 0")
    pos, w = F.col("position").cast("int"), F.col("__w")

    def crossing(share: float, rising: bool) -> Column:
        level = F.col("__peak") * share
        where = F.sequence(F.lit(0), F.greatest(pos - 1, F.lit(0))) if rising else F.sequence(pos, F.size(w) - 1)
        hit = F.get(F.filter(where, lambda i: (i < pos) & (F.get(w, i) >= level) if rising else F.get(w, i) <= level), 0)
        first = 0 if rising else pos
        a, b = F.get(w, hit - 1), F.get(w, hit)
        exact = hit.cast("double") if not interpolate else F.when((hit == first) | (F.abs(b - a) < 1e-10), hit.cast("double")).otherwise(hit - 1 + (level - a) / (b - a))
        return exact

    df = df.withColumns({"__rl": crossing(rise_low, True), "__rh": crossing(rise_high, True), "__fh": crossing(fall_high, False), "__fl": crossing(fall_low, False)})
    zero = F.lit(0.0)
    spans = {"rise_time": F.coalesce(F.col("__rh") - F.col("__rl"), zero), "fall_time": F.coalesce(F.col("__fl") - F.col("__fh"), zero), "total_width": F.coalesce(F.col("__fl") - F.col("__rl"), zero)}
    return df.select(*[(v / rate_ghz).alias(k) for k, v in spans.items()], *[v.alias(f"{k}_samples") for k, v in spans.items()], F.col("position").alias("peak_position"), F.col("__peak").alias("peak_height"), "timestamp", "board", "channel", "record_id")


def classify_s1_s2(df: DataFrame, s1: Mapping[str, tuple], s2: Mapping[str, tuple], conflict: str = "unknown", strict: bool = False) -> DataFrame:
    """label 1 or 2 by closed ranges of width, area and height (None: open end); 0 where neither or, by the policy, both fit. NaN fits no bound."""
    if conflict not in ("unknown", "prefer_s1", "prefer_s2"):
        raise ValueError("conflict must be unknown, prefer_s1 or prefer_s2")
    if strict and not (s1 or s2):
        raise ValueError("no range is configured")
    names = {"width": "width_ns", "area": "area", "height": "height"}

    def fits(ranges: Mapping[str, tuple]) -> Column:
        out = F.lit(bool(ranges))
        for k, (lo, hi) in ranges.items():
            c = F.col(names[k])
            for bound, test in ((lo, c >= F.lit(lo)), (hi, c <= F.lit(hi))):
                if bound is not None:
                    out = out & F.coalesce(test & ~F.isnan(c), F.lit(False))
        return out

    both = {"unknown": 0, "prefer_s1": 1, "prefer_s2": 2}[conflict]
    a, b = fits(s1), fits(s2)
    return df.withColumn("label", F.when(a & b, both).when(a, 1).when(b, 2).otherwise(0))


def record_metrics(waveforms: DataFrame) -> DataFrame:
    """Preview values per record: height and area of the downward signal, index and raw value of its peak."""
    s = W.normalized(F.col("wave"), F.col("baseline"), F.col("polarity"))
    df = waveforms.withColumn("__s", s)
    index = F.array_position("__s", F.array_min("__s")).cast("int") - 1
    return df.select("record_id", "timestamp", "board", "channel", (-F.array_min("__s")).alias("height"), (-W.total(F.col("__s"))).alias("area"), index.alias("peak_index"), F.get("wave", index).alias("peak_value"))


def record_waves(waveforms: DataFrame, start: int | None = None, end: int | None = None, pad_to: int | None = None, baseline_correct: bool = False, record_ids: DataFrame | None = None) -> DataFrame:
    """record_id, samples, mask: samples [start, end) of each record, cut to what it has, filled with zeros to pad_to; mask is true on samples.

    record_ids: a table of them to look up, of which unknown ones have null samples.
    """
    x = F.transform("wave", lambda v: v.cast("double") - F.col("baseline")) if baseline_correct else F.col("wave")
    kind = "double" if baseline_correct else waveforms.schema["wave"].dataType.elementType
    out = waveforms.select("record_id", W.window(x, start or 0, end).alias("samples"))
    n = F.size("samples")
    more = F.greatest(F.lit(pad_to or 0) - n, F.lit(0))
    padded = F.concat("samples", F.array_repeat(F.lit(0).cast(kind), more))
    out = out.select("record_id", padded.alias("samples"), F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), more)).alias("mask"))
    return out if record_ids is None else record_ids.select("record_id").join(out, "record_id", "left")


def preview_features(waveforms: DataFrame, start: int = 40, end: int | None = 90) -> DataFrame:
    """record_id, height, position, charge below the baseline over samples [start, end), whatever the polarity; NaN (position null) where a record has none of them."""
    drop = F.transform(W.window(F.col("wave"), start, end), lambda v: F.col("baseline") - v)
    out = waveforms.select("record_id", drop.alias("__d"))
    some, nan = F.size("__d") > 0, F.lit(float("nan"))
    return out.select(
        "record_id",
        F.when(some, F.array_max("__d")).otherwise(nan).alias("height"),
        F.when(some, F.array_position("__d", F.array_max("__d")) - 1 + start).alias("position"),
        F.when(some, W.total(F.col("__d"))).otherwise(nan).alias("charge"),
    )


def length_mismatches(waveforms: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of waveforms whose record is missing from records, or has another event_length there."""
    known = records.select("record_id", F.col("event_length").alias("__n"), F.lit(True).alias("__known"))
    joined = waveforms.join(known, "record_id", "left")
    return joined.where(F.col("__known").isNull() | ~F.col("__n").eqNullSafe(F.size("wave"))).select("record_id", F.size("wave").alias("wave_length"), F.col("__n").alias("event_length"))


def attach_by_record(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """left with columns of right by record_id, null where right has no such record."""
    return left.join(right.select("record_id", *columns), "record_id", "left")


def unique_records(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The same rows; a record_id that stands twice fails the job, and so does one that `known` doesn't hold."""
    n = records.groupBy(F.col("record_id").alias("__id")).agg(F.count("*").alias("__n"))
    if known is not None:
        n = n.join(known.select(F.col("record_id").alias("__id"), F.lit(True).alias("__known")).distinct(), "__id", "left")
    bad = F.when(F.col("__n") > 1, "twice: ") if known is None else F.when(F.col("__n") > 1, "twice: ").when(F.col("__known").isNull(), "unknown: ")
    fine = n.where(F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("record "), bad, F.col("__id"))).cast("boolean")).otherwise(F.lit(True)))
    return records.join(fine.select(F.col("__id").alias("record_id")), "record_id", "left_semi")


def preview_filter(records: DataFrame, record_ids: Sequence[int] | None = None, board: int | None = None, channel: int | None = None, start: int | None = None, end: int | None = None, height: tuple[float | None, float | None] = (None, None), area: tuple[float | None, float | None] = (None, None), limit: int | None = None) -> DataFrame:
    """Records to look at: those of record_ids in the list's order, or by board, channel and closed range of timestamps; then by closed ranges of height and area; then the first `limit` of them in time."""
    if record_ids is not None:
        asked = records.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(dict.fromkeys(record_ids))], "__at long, record_id long")
        out, order = records.join(asked, "record_id"), ["__at"]
    else:
        out, order = records, [c for c in ("timestamp", "board", "channel", "record_id") if c in records.columns]
        bounds = [(board, F.col("board") == board), (channel, F.col("channel") == channel), (start, F.col("timestamp") >= start), (end, F.col("timestamp") <= end)]
        for value, test in bounds:
            out = out if value is None else out.where(test)
    for name, (lo, hi) in (("height", height), ("area", area)):
        out = out if lo is None else out.where((F.col(name) >= lo) & ~F.isnan(name))
        out = out if hi is None else out.where(F.col(name) <= hi)
    out = out.orderBy(*order)
    return (out if limit is None else out.limit(limit)).drop("__at")
