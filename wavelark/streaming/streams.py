"""Detection and grouping on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.hits import peak_hits

#: Added to event times, in ms: those at or before the first watermark, 0, would count as late.
_ORIGIN_MS = 1_000_000_000_000
_STATE = "anchor long, last long, n long, low double, high double, total double, times array<long>, heights array<double>, areas array<double>"
_EVENT = "board int, channel int, t_min long, t_max long, n_hits long, min_height double, max_height double, total_area double"


def stream_peaks(waveforms: DataFrame, **options) -> DataFrame:
    """Peaks of records as they arrive: no state, so any stream of waveform rows will do. Height by the derivative, as on chunks."""
    return peak_hits(waveforms, **({"height_method": "diff"} | options))


def stream_clusters(hits: DataFrame, window: int, gap: int | None = None, ticks_per_ms: int = 1_000_000_000, late: str = "0 seconds") -> DataFrame:
    """hits(board, channel, timestamp, height, area), a stream -> clusters, once nothing can join them any more.

    Anchored: a cluster holds what lies within window of its first hit. With gap, chained instead: what
    lies within gap of its last hit. Hits may come in any order within `late`, the delay of the watermark;
    older ones Spark drops. State per channel is the open cluster and the hits that the watermark hasn't
    reached. A cluster ends when the watermark has passed what could join it, whether or not its channel
    gets another hit. A row without a height is no hit but tells the time (timestamp) and so moves the
    watermark: `end_of_stream` makes one that ends all open clusters.
    """

    def closes(anchor: int, last: int) -> int:
        return last + gap if gap is not None else anchor + window

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else None
        now = list(kept[:6]) if kept and kept[2] else None
        held = list(zip(*kept[6:], strict=True)) if kept else []
        for pdf in batches:
            some = pdf[pdf["height"].notna()]
            held += zip(some["timestamp"].tolist(), some["height"].tolist(), some["area"].tolist(), strict=True)
        passed = (state.getCurrentWatermarkMs() - _ORIGIN_MS) * ticks_per_ms
        held.sort()
        out, ready = [], sum(t < passed for t, _, _ in held)
        for t, h, a in held[:ready]:
            if now is not None and t <= closes(now[0], now[1]):
                now = [now[0], t, now[2] + 1, min(now[3], h), max(now[4], h), now[5] + a]
            else:
                if now is not None:
                    out.append((*key, *now))
                now = [t, t, 1, h, h, a]
        held = held[ready:]
        if now is not None and closes(now[0], now[1]) < passed:
            out.append((*key, *now))
            now = None
        if now is None and not held:
            if state.exists:
                state.remove()
        else:
            state.update((*(now or (0, 0, 0, 0.0, 0.0, 0.0)), *([x[k] for x in held] for k in range(3))))
            due = min([closes(now[0], now[1])] if now else [held[0][0]])
            state.setTimeoutTimestamp(max(due // ticks_per_ms + 1 + _ORIGIN_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _EVENT.split(", ")])

    timed = hits.withColumn("event_time", F.timestamp_millis(F.floor(F.col("timestamp") / ticks_per_ms) + _ORIGIN_MS)).withWatermark("event_time", late)
    return timed.groupBy("board", "channel").applyInPandasWithState(step, _EVENT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def end_of_stream(spark: SparkSession, last: int, reach: int, late_ms: int = 0, ticks_per_ms: int = 1_000_000_000) -> DataFrame:
    """One row, to be put into the stream after all hits (the latest at `last`), that moves the watermark past every cluster; reach: the window or gap."""
    end = last + reach + (late_ms + 2) * ticks_per_ms
    return spark.createDataFrame([(-1, -1, end, None, None)], "board int, channel int, timestamp long, height double, area double")


def with_halo(rows: DataFrame, chunk: int, left: int, right: int, time: str = "time") -> DataFrame:
    """Rows of fixed chunks of time, and of the stretches on both sides that a chunk's computation looks at: main_start, main_end, is_main."""
    k = F.floor(F.col(time) / chunk)
    out = rows.withColumn("chunk", F.explode(F.sequence(F.floor((F.col(time) - right) / chunk), F.floor((F.col(time) + left) / chunk))))
    return out.withColumns({"main_start": F.col("chunk") * chunk, "main_end": (F.col("chunk") + 1) * chunk, "is_main": F.col("chunk") == k})


def clip_to_main(rows: DataFrame, strict: bool = False, time: str = "time", end: str = "endtime") -> DataFrame:
    """Results of halo chunks that overlap their main range (strict: lie in it); each of the others is its neighbour's."""
    lies = (F.col(time) >= F.col("main_start")) & (F.col(end) <= F.col("main_end")) if strict else (F.col(end) > F.col("main_start")) & (F.col(time) < F.col("main_end"))
    return rows.where(lies)


def run_available(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append") -> None:
    """Writes all that is there now to Parquet and stops; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def union_streams(*streams: DataFrame) -> DataFrame:
    """Rows of several streams, or tables, as one; columns by name, absent ones null."""
    if not streams:
        raise ValueError("there is no stream to unite")
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
