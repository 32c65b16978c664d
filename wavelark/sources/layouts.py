"""Where files of a run lie, and which channel and place in order each has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """folder: path below the root with {run}; glob: file names; channel and index: regexes with one group on the file name, case ignored."""

    folder: str
    glob: str
    channel: str
    index: str


@dataclass(frozen=True)
class Format:
    """Text or binary format of a digitizer. Columns count from 0; header: what a header line begins with, in capitals; unit: of the timestamp column."""

    name: str
    layout: str
    delimiter: str = ";"
    board: int = 0
    channel: int = 1
    timestamp: int = 2
    samples: int = 7
    baseline: tuple[int, int] = (7, 47)
    unit: str = "ps"
    rate_ghz: float = 0.5
    header: str = r"^(BOARD|META|HEADER)"
    binary: bool = False

    @property
    def dt_ns(self) -> int:
        return round(1 / self.rate_ghz)


#: Layouts and formats known by name.
LAYOUTS = {
    "vx2730": Layout("{run}/RAW", "*CH*.[Cc][Ss][Vv]", r"CH(\d+)", r"_(\d+)\.csv$"),
    "flat": Layout("{run}", "*.[Cc][Ss][Vv]", r"ch(\d+)", r"_(\d+)\.csv$"),
    "v1725": Layout("{run}", "*.bin", r"(?:CH|_b)(\d+)", r"_(?:seg)?(\d+)\.bin$"),
}
FORMATS = {
    "vx2730": Format("vx2730", "vx2730"),
    "v1725": Format("v1725", "v1725", unit="sample_index", rate_ghz=0.25, binary=True),
}


class Registry:
    """Named formats or layouts; names are looked up in lower case."""

    def __init__(self, items: dict):
        self.items = dict(items)

    def register(self, name: str, item, replace: bool = False) -> None:
        if name.lower() in self.items and not replace:
            raise ValueError(f"{name} is registered already")
        self.items[name.lower()] = item

    def get(self, name: str):
        if name.lower() not in self.items:
            raise KeyError(f"{name} isn't one of {', '.join(sorted(self.items))}")
        return self.items[name.lower()]

    def names(self) -> list[str]:
        return sorted(self.items)

    def unregister(self, name: str) -> bool:
        return self.items.pop(name.lower(), None) is not None


formats, layouts = Registry(FORMATS), Registry(LAYOUTS)


def _place(name, layout: Layout) -> tuple:
    base = F.element_at(F.split(name, "/"), -1)
    channel, index = F.regexp_extract(base, f"(?i){layout.channel}", 1), F.regexp_extract(base, f"(?i){layout.index}", 1)
    return F.when(channel != "", channel.cast("int")), F.coalesce(F.when(index != "", index.cast("int")), F.lit(0))


def raw_files(spark: SparkSession, root: str, run: str, layout: str = "vx2730") -> DataFrame:
    """channel, file_index, path, size, modified for the files of a run; files without a channel in their name are left out."""
    rule = layouts.get(layout)
    files = spark.read.format("binaryFile").option("pathGlobFilter", rule.glob).load(f"{root}/{rule.folder.format(run=run)}").select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    channel, index = _place(F.col("path"), rule)
    return files.select(channel.alias("channel"), index.alias("file_index"), "path", "size", "modified").where("channel is not null")


def file_groups(files: DataFrame) -> DataFrame:
    """Per channel, its paths in order."""
    return files.groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_index", "path"))), lambda x: x["path"]).alias("paths"))


def distinct_paths(*lists: list[str]) -> list[str]:
    """The paths of all lists in the order in which they first come."""
    return list(dict.fromkeys(p for some in lists for p in some))
