"""Row-generating detectors: threshold runs natively, peaks by NumPy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import waves as W
from .features import with_channel_values


def find_hits(waveforms: DataFrame, threshold: float) -> DataFrame:
    """Starts of the runs of baseline - wave > threshold: event_index, position."""
    flags = F.transform("wave", lambda x: F.col("baseline") - x.cast("double") > threshold)
    runs = waveforms.withColumn("__f", flags).select(F.col("record_id").alias("event_index"), W.runs(F.col("__f")).alias("__r"))
    return runs.select("event_index", F.explode("__r.start").alias("position"))


def threshold_hits(waveforms: DataFrame, threshold: float = 10, left: int = 2, right: int = 2, per_channel: Mapping[tuple[int, int], float] | None = None) -> DataFrame:
    """Runs of signal >= threshold, widened by left and right samples within the record: one row per run, as dataset hit_threshold.

    The signal is wave - baseline for positive records, baseline - wave else. Position and height are of
    the first largest sample of the widened window, integral sums its positive part; rise and fall times
    count from the ends of the run itself, at least 0.
    """
    df = waveforms
    limit = F.lit(float(threshold))
    if per_channel:
        df = with_channel_values(df, {k: {"__thr": float(v)} for k, v in per_channel.items()}, {"__thr": "double"})
        limit = F.coalesce("__thr", limit)
    df = df.withColumn("__t", limit)
    both = lambda x: F.struct(x.alias("s"), W.runs(F.transform(x, lambda y: y >= F.col("__t"))).alias("r"))
    df = df.withColumn("__g", W.let(W.pulse(F.col("wave"), F.col("baseline"), F.col("polarity")), both))
    df = df.select("timestamp", "board", "channel", "record_id", "dt", F.col("__g.s").alias("__s"), F.explode("__g.r").alias("__r"))
    df = df.withColumn("edge_start", F.greatest(F.col("__r.start") - left, F.lit(0))).withColumn("edge_end", F.least(F.col("__r.end") + right, F.size("__s")))
    df = df.withColumn("__w", F.slice("__s", F.col("edge_start") + 1, F.col("edge_end") - F.col("edge_start"))).withColumn("position", (F.col("edge_start") + W.argmax(F.col("__w"))).cast("long"))
    step = F.col("dt").cast("double")
    return df.select(
        "position", F.array_max("__w").alias("height"), W.total(F.filter("__w", lambda x: x > 0)).alias("integral"), "edge_start", "edge_end", (F.col("edge_end") - F.col("edge_start")).cast("double").alias("width"), "dt",
        F.greatest((F.col("position") - F.col("__r.start")) * step, F.lit(0.0)).alias("rise_time"), F.greatest((F.col("__r.end") - 1 - F.col("position")) * step, F.lit(0.0)).alias("fall_time"),
        (F.col("timestamp") + F.col("position") * F.col("dt") * 1000).alias("timestamp"), "board", "channel", "record_id",
    )


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Middles (rounded down) of the flat tops that both neighbours lie below; ends never count."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(np.diff(x) != 0)
    starts = np.concatenate(([0], change + 1))
    ends = np.concatenate((change, [len(x) - 1]))
    level = x[starts]
    top = np.zeros(len(starts), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (starts[top] + ends[top]) // 2


def _spaced(peaks: np.ndarray, heights: np.ndarray, distance: float) -> np.ndarray:
    """Highest first, each peak drops lower ones nearer than the distance."""
    keep = np.ones(len(peaks), bool)
    for k in np.argsort(heights, kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(peaks - peaks[k]) < distance
            near[k] = False
            keep &= ~near
    return keep


def prominences(x: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Height over the higher of the two lowest points up to the next higher sample on either side, and where these lie."""
    left, right = np.zeros(len(peaks), np.int64), np.zeros(len(peaks), np.int64)
    for k, p in enumerate(peaks):
        higher = np.flatnonzero(x[:p] > x[p])
        lo = int(higher[-1]) + 1 if len(higher) else 0
        seg = x[lo : p + 1]
        left[k] = p - int(np.argmin(seg[::-1]))
        higher = np.flatnonzero(x[p + 1 :] > x[p])
        hi = p + 1 + int(higher[0]) if len(higher) else len(x)
        right[k] = p + int(np.argmin(x[p:hi]))
    return x[peaks] - np.maximum(x[left], x[right]), left, right


def half_widths(x: np.ndarray, peaks: np.ndarray, prominence: np.ndarray, left: np.ndarray, right: np.ndarray, share: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Width at a share of the prominence below the top, and the interpolated crossings on both sides."""
    lo, hi = np.zeros(len(peaks)), np.zeros(len(peaks))
    for k, p in enumerate(peaks):
        level = x[p] - prominence[k] * share
        i = p
        while i > left[k] and x[i] > level:
            i -= 1
        lo[k] = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else i
        i = p
        while i < right[k] and x[i] > level:
            i += 1
        hi[k] = i - (level - x[i]) / (x[i - 1] - x[i]) if x[i] < level else i
    return hi - lo, lo, hi


def find_peaks(x: np.ndarray, height: float | None = None, distance: float | None = None, prominence: float | None = None, width: float | None = None, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(peaks, left crossing, right crossing) after the conditions in the order height, threshold, distance, prominence, width."""
    peaks = local_maxima(x)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if threshold is not None:
        peaks = peaks[np.minimum(x[peaks] - x[peaks - 1], x[peaks] - x[peaks + 1]) >= threshold]
    if distance is not None:
        if distance < 1:
            raise ValueError("distance must be 1 or more")
        peaks = peaks[_spaced(peaks, x[peaks], distance)]
    p, left, right = prominences(x, peaks)
    if prominence is not None:
        ok = p >= prominence
        peaks, p, left, right = peaks[ok], p[ok], left[ok], right[ok]
    w, lo, hi = half_widths(x, peaks, p, left, right)
    ok = w >= (width if width is not None else -1)
    return peaks[ok], lo[ok], hi[ok]


HIT = "position long, height double, integral double, edge_start double, edge_end double, dt int, timestamp long, board int, channel int, record_id long"


def peak_rows(pdf: pd.DataFrame, use_derivative: bool = True, height: float = 30, distance: float = 2, prominence: float = 0.7, width: float = 4, threshold: float | None = None, height_method: str = "minmax", extension: int = 4) -> pd.DataFrame:
    rows = []
    for r in pdf.itertuples(index=False):
        up = 1.0 if r.polarity == "positive" else -1.0
        wave = np.asarray(r.wave, np.float64)
        signal = np.diff(wave) * up if use_derivative else (wave - r.baseline) * up
        for p, lo, hi in zip(*find_peaks(signal, height, distance, prominence, width, threshold), strict=True):
            if height_method == "diff":
                a, b = max(0, int(np.floor(lo))), min(len(wave), int(np.ceil(hi)) + 1)
            else:
                a, b = max(0, int(np.floor(lo)) - extension), min(len(wave), int(np.ceil(hi)) + extension + 1)
            seg = wave[a:b]
            tall = float(signal[p]) if height_method == "diff" else float(seg.max() - seg.min()) if len(seg) else 0.0
            rows.append((int(p), tall, 0.0, float(lo), float(hi), int(r.dt), int(r.timestamp) + int(p) * int(r.dt) * 1000, int(r.board), int(r.channel), int(r.record_id)))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in HIT.split(", ")])


def peak_hits(waveforms: DataFrame, **options) -> DataFrame:
    """Peaks of the derivative (or the signal) by height, distance, prominence and width, as dataset hit. Works on streams: it has no state."""
    if options.get("height_method", "minmax") not in ("minmax", "diff"):
        raise ValueError("height_method must be minmax or diff")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield peak_rows(pdf, **options)

    return waveforms.select("wave", "baseline", "polarity", "timestamp", "board", "channel", "record_id", "dt").mapInPandas(run, HIT)
