"""Delimited text files of waveforms: one row per record, samples to the end of the line."""

from __future__ import annotations

import re
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeunits as U
from ..functions import waves as W
from .layouts import Format, _place, formats, layouts


def parse_lines(lines: DataFrame, fmt: Format) -> DataFrame:
    """lines(value [, path]) -> board, channel, timestamp (ps), baseline, wave. Header lines go, and lines without a numeric timestamp or with a sample that is no number (see bad_lines); empty fields at the end are no samples."""
    cells = F.split("value", re.escape(fmt.delimiter), -1)
    df = lines.withColumn("__c", cells)
    number = lambda k: F.expr(f"try_cast(trim(get(__c, {k})) as double)")
    df = df.where(~F.upper(F.trim("value")).rlike(fmt.header) & number(fmt.timestamp).isNotNull())
    samples = F.filter(F.transform(F.slice("__c", fmt.samples + 1, F.greatest(F.size("__c") - fmt.samples, F.lit(0))), lambda x: F.trim(x)), lambda x: x != "")
    df = df.withColumn("wave", F.transform(samples, lambda x: x.try_cast("double").try_cast("int"))).where(~F.exists("wave", lambda x: x.isNull()))
    lo, hi = fmt.baseline[0] - fmt.samples, fmt.baseline[1] - fmt.samples
    ticks = F.coalesce(F.expr(f"try_cast(trim(get(__c, {fmt.timestamp})) as bigint)"), number(fmt.timestamp).cast("long"))
    path = ["path"] if "path" in lines.columns else []
    return df.select(*path, F.coalesce(number(fmt.board).cast("int"), F.lit(0)).alias("board"), number(fmt.channel).cast("int").alias("channel"), U.to_ps(ticks, fmt.unit, fmt.dt_ns).alias("timestamp"), W.mean(F.col("wave"), lo, hi).alias("baseline"), "wave")


def bad_lines(lines: DataFrame, fmt: Format) -> DataFrame:
    """Lines that parse_lines leaves out and that are neither headers nor blank: their value, and path where there is one."""
    good = lines.withColumn("__id", F.xxhash64(*lines.columns))
    kept = parse_lines(lines.select(F.xxhash64(*lines.columns).cast("string").alias("path"), "value"), fmt).select(F.col("path").cast("long").alias("__id")).distinct()
    cells = F.split("value", re.escape(fmt.delimiter), -1)
    filled = F.size(F.filter(cells, lambda x: F.trim(x) != "")) > 0
    return good.join(kept, "__id", "left_anti").where(~F.upper(F.trim("value")).rlike(fmt.header) & filled).drop("__id")


def read_text_waveforms(spark: SparkSession, paths: str | list[str], fmt: str | Format = "vx2730") -> DataFrame:
    """All files at once; a line that the header rule fits is a header wherever it stands, so files need no order."""
    fmt = formats.get(fmt) if isinstance(fmt, str) else fmt
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    return parse_lines(lines, fmt)


def read_run(spark: SparkSession, root: str, run: str, fmt: str = "vx2730") -> DataFrame:
    """Records of a run with run_id, and file_channel and file_index from the file names."""
    f = formats.get(fmt)
    layout = layouts.get(f.layout)
    where = f"{root}/{layout.folder.format(run=run)}"
    if f.binary:
        from .v1725 import read_binary

        return read_binary(spark, where, f).withColumn("run_id", F.lit(run))
    lines = spark.read.option("pathGlobFilter", layout.glob).text(where).select("value", F.col("_metadata.file_path").alias("path"))
    channel, index = _place(F.col("path"), layout)
    return parse_lines(lines, f).withColumns({"run_id": F.lit(run), "file_channel": channel, "file_index": index}).where("file_channel is not null").drop("path")


def stream_text_waveforms(spark: SparkSession, folder: str, fmt: str | Format = "vx2730", files_per_trigger: int = 100) -> DataFrame:
    """The same records from files as they arrive."""
    fmt = formats.get(fmt) if isinstance(fmt, str) else fmt
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder), fmt)


def sniff(lines: list[str]) -> tuple[str, int]:
    """(delimiter, first data row) of a file's first lines: the mark that stands most often in a line, and the first row of mostly numbers."""
    def often(mark: str) -> float:
        return median([x.count(mark) for x in lines if x.strip()] or [0])

    best = max([";", ",", "\t", "|"], key=often)

    def numeric(cell: str) -> bool:
        try:
            float(cell)
        except ValueError:
            return False
        return True

    for k, line in enumerate(lines):
        cells = [c.strip() for c in line.split(best)[:8]]
        if cells and sum(map(numeric, cells)) >= 0.6 * len(cells):
            return best, k
    return best, 0


def run_statistics(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Per channel: files, bytes, first and last timestamp, duration in s, first and last change of a file."""
    tags = rows.groupBy(F.col("file_channel").alias("channel")).agg(F.count("*").alias("records"), F.min("timestamp").alias("first_ps"), F.max("timestamp").alias("last_ps"))
    by = files.groupBy("channel").agg(F.count("*").alias("file_count"), F.sum("size").alias("bytes"), F.min("modified").alias("first_modified"), F.max("modified").alias("last_modified"))
    return by.join(tags, "channel", "left").withColumn("duration_s", (F.col("last_ps") - F.col("first_ps")) / 1e12)


def preview(rows: DataFrame, channel: int, start: int, end: int, by: str = "event") -> DataFrame:
    """Records [start, end) of a channel by number in time, or by timestamp."""
    df = rows.where(F.col("channel") == channel)
    if by == "timestamp":
        return df.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    return df.orderBy("timestamp", *[c for c in ("board", "file_index") if c in rows.columns], "wave").offset(start).limit(max(0, end - start))


def wave_length(lines: DataFrame, fmt: Format) -> DataFrame:
    """One row: samples of the shortest and longest record, and how many records there are."""
    n = F.size("wave")
    return parse_lines(lines, fmt).agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.count("*").alias("records"))


def runs_overview(spark: SparkSession, root: str, layout: str = "vx2730") -> DataFrame:
    """One row per run below root: files, channels, bytes, first and last change of a file. Only the list of files is read."""
    rule = layouts.get(layout)
    files = spark.read.format("binaryFile").option("pathGlobFilter", rule.glob).load(f"{root}/{rule.folder.format(run='*')}").select("path", "length", "modificationTime")
    depth = -2 - rule.folder.count("/")
    channel, _ = _place(F.col("path"), rule)
    named = files.select(F.element_at(F.split("path", "/"), depth).alias("run_id"), channel.alias("channel"), "length", "modificationTime").where("channel is not null")
    return named.groupBy("run_id").agg(F.count("*").alias("file_count"), F.count_distinct("channel").alias("channels"), F.sum("length").alias("bytes"), F.min("modificationTime").alias("first_modified"), F.max("modificationTime").alias("last_modified"))
