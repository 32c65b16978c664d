"""Column types of the named datasets, in their order. Times: timestamp in ps, time and dt in ns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Field names and types of each dataset.
SCHEMAS = {
    "st_waveforms": "baseline double, baseline_upstream double, polarity string, timestamp long, record_id long, dt int, event_length int, board short, channel short, wave array<short>",
    "filtered_waveforms": "baseline double, baseline_upstream double, polarity string, timestamp long, record_id long, dt int, event_length int, board short, channel short, wave array<float>",
    "records": "timestamp long, pid int, board short, channel short, baseline double, baseline_upstream double, polarity string, record_id long, dt int, trigger_type short, flags long, wave_offset long, event_length int, time long",
    "basic_features": "height float, amp float, area float, max_abs_diff float, timestamp long, board short, channel short, event_index long",
    "hit": "position long, height float, integral float, edge_start float, edge_end float, dt int, timestamp long, board short, channel short, record_id long",
    "hit_threshold": "position long, height float, integral float, edge_start int, edge_end int, width float, dt int, rise_time float, fall_time float, timestamp long, board short, channel short, record_id long",
    "hit_merged": "position long, height float, integral float, sample_start int, sample_end int, width float, dt int, rise_time float, fall_time float, timestamp long, board short, channel short, record_id long, component_offset long, component_count int",
    "hit_merge_clusters": "cluster_index long, hit_index long",
    "hit_merged_components": "merged_index long, hit_index long",
    "waveform_width": "rise_time float, fall_time float, total_width float, rise_time_samples float, fall_time_samples float, total_width_samples float, peak_position long, peak_height float, timestamp long, board short, channel short, record_id long",
    "waveform_width_integral": "t_low float, t_high float, width float, t_low_samples float, t_high_samples float, width_samples float, q_total double, timestamp long, board short, channel short, event_index long",
    "s1_s2": "label byte, width_ns float, width_samples float, height float, area float, timestamp long, board short, channel short, record_id long, peak_position long",
    "df_events": "event_id long, t_min long, t_max long, `dt/ns` double, n_hits int, channels array<short>, areas array<float>, heights array<float>, timestamps array<long>",
}


def fields(name: str) -> list[tuple[str, str]]:
    return [tuple(f.strip().replace("`", "").split(" ", 1)) for f in SCHEMAS[name].split(", ")]


def conform(df: DataFrame, name: str) -> DataFrame:
    """The dataset's fields, in order and cast to its types; a missing field is an error."""
    return df.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in fields(name)])
