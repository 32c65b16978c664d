"""The default chain of datasets, from raw files to paired events."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import features as FE
from ..operators import hits as H
from ..operators import intervals as I
from ..operators import signals as S
from ..sources.layouts import formats, raw_files
from ..sources.text import read_run
from .catalog import Context, Node, Option

_SOURCE = Option("st_waveforms", str, ("st_waveforms", "filtered_waveforms"))
_WINDOW = Option(100.0, float, least=0)


def _waves(options: dict) -> tuple[str, ...]:
    return (options["wave_source"],)


def _structured(ctx: Context, run: str, inputs: dict, o: dict):
    fmt = formats.get(o["daq_adapter"])
    rows = read_run(ctx.spark, o["data_root"], run, o["daq_adapter"])
    lo, hi = (k - fmt.samples for k in fmt.baseline)
    run_values = (o["run_channel_values"] or {}).get(run)
    channels = [tuple(c) for c in o["channels"] or []] or sorted({*(o["channel_values"] or {}), *(run_values or {}), *(tuple(c) for members, _ in o["channel_groups"] or () for c in members)})
    values = FE.layered_values(channels, o["channel_defaults"], o["channel_groups"] or (), o["channel_values"], run_values)
    known = {c: v["polarity"] for c, v in values.items() if "polarity" in v}
    return I.sort_records(FE.structure_waveforms(rows, lo, hi, fmt.dt_ns, known), ("timestamp", "board", "channel"))


def _classified(ctx: Context, run: str, inputs: dict, o: dict):
    """Widths beside heights and areas, by record; a record without a width has none to fit."""
    widths = inputs["waveform_width_integral"].select("event_index", F.col("width").alias("width_ns"))
    return FE.classify_s1_s2(inputs["basic_features"].join(widths, "event_index", "left"), o["s1"] or {}, o["s2"] or {}, o["conflict"], bool(o["strict"]))


def _files_stamp(ctx: Context, run: str, o: dict) -> str:
    """Number, sizes and times of a run's files, so that changed data under the same options is not taken from the store."""
    try:
        r = raw_files(ctx.spark, o["data_root"], run, formats.get(o["daq_adapter"]).layout).agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "size", "modified").cast("decimal(38,0)")).alias("h")).first()
    except AnalysisException:  # no such folder
        return ""
    return f"{r.n}:{r.h}"


def cpu_default() -> list[Node]:
    adapter, root = Option("vx2730", str), Option("DAQ", str)
    hit_options = {"wave_source": _SOURCE, "threshold": Option(10.0, float), "left_extension": Option(2, int, least=0), "right_extension": Option(2, int, least=0)}
    merge = {"merge_gap_ns": Option(0.0, float, least=0), "max_total_width_ns": Option(10_000.0, float, least=0)}

    def clusters(inputs: dict, o: dict):
        h = C.number(inputs["hit_threshold"], "hit_index", ["record_id", "position"])
        return C.merge_clusters(h, o["merge_gap_ns"], o["max_total_width_ns"])

    return [
        Node("raw_files", lambda c, r, i, o: raw_files(c.spark, o["data_root"], r, formats.get(o["daq_adapter"]).layout), options={"data_root": root, "daq_adapter": adapter}),
        Node("st_waveforms", _structured, options={"data_root": root, "daq_adapter": adapter, "channels": Option(None), "channel_defaults": Option(None), "channel_groups": Option(None), "channel_values": Option(None), "run_channel_values": Option(None)}, save_when="always", stamp=_files_stamp),
        Node("records", lambda c, r, i, o: S.wave_pool(i["st_waveforms"]).withColumn("time", F.floor(F.col("timestamp") / 1000)), ("st_waveforms",), save_when="always"),
        Node("filtered_waveforms", lambda c, r, i, o: S.filter_waveforms(i["st_waveforms"], **o), ("st_waveforms",), {"filter_type": Option("SG", str, ("SG", "BW")), "lowcut": Option(0.1, float), "highcut": Option(0.5, float), "fs": Option(0.5, float), "filter_order": Option(4, int, least=1), "sg_window_size": Option(11, int, least=1), "sg_poly_order": Option(2, int, least=0)}, save_when="target"),
        Node("wave_pool_filtered", lambda c, r, i, o: S.filtered_pool(i["records"], **o), ("records",), {"filter_type": Option("SG", str, ("SG", "BW")), "lowcut": Option(0.1, float), "highcut": Option(0.5, float), "fs": Option(0.5, float), "filter_order": Option(4, int, least=1), "sg_window_size": Option(11, int, least=1), "sg_poly_order": Option(2, int, least=0)}, save_when="target"),
        Node("basic_features", lambda c, r, i, o: FE.basic_features(i[o["wave_source"]], o["height_range"], o["area_range"]), _waves, {"wave_source": _SOURCE, "height_range": Option((40, 90)), "area_range": Option((0, None))}, save_when="always"),
        Node("df", lambda c, r, i, o: FE.record_frame(i[o["wave_source"]], gain=o["gain_adc_per_pe"]), _waves, {"wave_source": _SOURCE, "gain_adc_per_pe": Option(None)}, save_when="always"),
        Node("df_events", lambda c, r, i, o: C.group_events(i["df"], o["time_window_ns"]), ("df",), {"time_window_ns": _WINDOW}, save_when="always"),
        Node("df_paired", lambda c, r, i, o: C.pair_events(i["df_events"], o["time_window_ns"], o["n_channels"], o["start_channel_slice"]), ("df_events",), {"time_window_ns": _WINDOW, "n_channels": Option(2, int, least=1), "start_channel_slice": Option(6, int)}, save_when="always"),
        Node("hit", lambda c, r, i, o: H.peak_hits(i[o["wave_source"]], height=o["height"], distance=o["distance"], prominence=o["prominence"], width=o["width"], use_derivative=o["use_derivative"], height_method=o["height_method"]), _waves, {"wave_source": Option("filtered_waveforms", str, ("st_waveforms", "filtered_waveforms")), "height": Option(30.0, float), "distance": Option(2, int, least=1), "prominence": Option(0.7, float), "width": Option(4.0, float), "use_derivative": Option(True), "height_method": Option("minmax", str, ("minmax", "diff"))}, save_when="always"),
        Node("hit_threshold", lambda c, r, i, o: H.threshold_hits(i[o["wave_source"]], o["threshold"], o["left_extension"], o["right_extension"]), _waves, hit_options, save_when="always"),
        Node("hit_merge_clusters", lambda c, r, i, o: C.hit_merge_clusters(clusters(i, o)), ("hit_threshold",), merge, save_when="always"),
        Node("hit_merged", lambda c, r, i, o: C.merged_hits(clusters(i, o)), ("hit_threshold",), merge, save_when="always"),
        Node("hit_merged_components", lambda c, r, i, o: C.merged_components(clusters(i, o)), ("hit_threshold",), merge, save_when="always"),
        Node("hit_grouped", lambda c, r, i, o: C.group_hit_windows(C.absolute_window(i["hit_threshold"]), o["time_window_ns"]), ("hit_threshold",), {"time_window_ns": _WINDOW}, save_when="always"),
        Node("waveform_width", lambda c, r, i, o: FE.pulse_widths(i["hit"], i["st_waveforms"], o["sampling_rate"]), ("hit", "st_waveforms"), {"sampling_rate": Option(0.5, float)}, save_when="always"),
        Node("waveform_width_integral", lambda c, r, i, o: FE.width_integral(i[o["wave_source"]], o["q_low"], o["q_high"]), _waves, {"wave_source": _SOURCE, "q_low": Option(0.1, float), "q_high": Option(0.9, float)}, save_when="always"),
        Node("s1_s2", _classified, ("waveform_width_integral", "basic_features"), {"s1": Option(None), "s2": Option(None), "conflict": Option("unknown", str, ("unknown", "prefer_s1", "prefer_s2")), "strict": Option(False)}, save_when="always"),
    ]
