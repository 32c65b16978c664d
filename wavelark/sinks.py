"""Exports of a dataset, one file set or one per run."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json", "npy", "npz", "orc")
#: Rows that formats of a single driver-side file may have.
MAX_ROWS = 10_000_000


def format_of(path: str, given: str | None = None) -> str:
    fmt = (given or path.rpartition(".")[2]).lower()
    if fmt not in FORMATS:
        raise ValueError(f"{fmt} isn't one of {', '.join(FORMATS)}")
    return fmt


def _flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def export(df: DataFrame, path: str, fmt: str | None = None, partition_by: str | None = None, compression: str | None = None, mode: str = "error") -> str:
    """Parquet, ORC, JSON and CSV are written by executors (nested columns as JSON in CSV); npy and npz hold at most MAX_ROWS rows, by the driver."""
    fmt = format_of(path, fmt)
    if fmt in ("npy", "npz"):
        import numpy as np

        table = df.limit(MAX_ROWS + 1).toPandas()
        if len(table) > MAX_ROWS:
            raise ValueError(f"over {MAX_ROWS} rows: use parquet")
        if fmt == "npy":
            np.save(path, table.to_records(index=False), allow_pickle=True)
        else:
            np.savez_compressed(path, **{c: table[c].to_numpy() for c in table})
        return path
    writer = (_flat(df) if fmt == "csv" else df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if compression:
        writer = writer.option("compression", compression)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
    return path


def batch_export(df: DataFrame, folder: str, name: str, fmt: str = "parquet", run_column: str = "run_id") -> str:
    """All runs in one job, a folder per run."""
    return export(df, f"{folder}/{name}", fmt, partition_by=run_column)


def content_checksum(df: DataFrame) -> str:
    """Independent of the order of rows and partitions: count and sum of row hashes, as a digest."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(json.dumps([row["n"], str(row["h"])]).encode()).hexdigest()
