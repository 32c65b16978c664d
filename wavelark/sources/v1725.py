"""Packed binary files: events with a channel mask, each channel with a header and 16-bit samples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layouts import Format, formats

SCHEMA = "path string, position long, board int, channel int, timestamp long, baseline double, trunc boolean, wave array<int>"


def decode(data: bytes) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
    """(channel, ticks, baseline, truncated, samples) in file order; a record that is cut short ends the file."""
    at = 0
    while at + 16 <= len(data):
        mask = data[at + 4] | data[at + 11] << 8
        at += 16
        for channel in range(16):
            if not mask >> channel & 1:
                continue
            if at + 12 > len(data):
                return
            head = data[at : at + 12]
            words = int.from_bytes(head[:3], "little") & 0x3FFFFF
            size = max(0, words - 3) * 4
            if at + 12 + size > len(data):
                return
            yield channel, int.from_bytes(head[4:10], "little"), int.from_bytes(head[10:12], "little"), bool(head[3] & 0x40), np.frombuffer(data, "<i2", size // 2, at + 12)
            at += 12 + size


def read_binary(spark: SparkSession, paths: str | list[str], fmt: str | Format = "v1725", glob: str = "*.bin") -> DataFrame:
    """board (from _b<n> in the name, else 0), channel, timestamp in ps, baseline, trunc, wave, and the record's position in its file.

    A file is decoded whole in one task; records are found only by walking from its start.
    """
    fmt = formats.get(fmt) if isinstance(fmt, str) else fmt
    tick = fmt.dt_ns * 1000 if fmt.unit == "sample_index" else 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found = re.search(r"_b(\d+)", path.rpartition("/")[2])
                board, rows = int(found[1]) if found else 0, []
                for k, (channel, ticks, base, trunc, wave) in enumerate(decode(content)):
                    rows.append((path, k, board, channel, ticks * tick, float(base), trunc, wave.tolist()))
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).select("path", F.col("content")).mapInPandas(run, SCHEMA)
