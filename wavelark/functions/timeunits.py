"""Units, sample counts, relative and absolute time. Ticks are whole numbers throughout."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Picoseconds in a unit, hertz in a unit.
PS = {"ps": 1, "ns": 1_000, "us": 1_000_000, "ms": 1_000_000_000, "s": 1_000_000_000_000}
HZ = {"Hz": 1, "kHz": 1_000, "MHz": 1_000_000, "GHz": 1_000_000_000}


def convert_time(value: Column, source: str, target: str) -> Column:
    """Exact for whole results; a double where the target is coarser."""
    a, b = PS[source], PS[target]
    return value * F.lit(a // b) if a % b == 0 else value / F.lit(b / a)


def to_ps(value: Column, unit: str, dt_ns: Column | int | None = None) -> Column:
    """Native timestamps in ps; unit sample_index needs dt in ns."""
    if unit == "sample_index":
        return (value * (dt_ns if isinstance(dt_ns, Column) else F.lit(dt_ns)) * 1000).cast("long")
    return (value * F.lit(PS[unit])).cast("long")


def rate_to_interval_ns(rate: float, unit: str = "GHz") -> float:
    if rate <= 0:
        raise ValueError("a rate must be positive")
    return 1e9 / (rate * HZ[unit])


def endtime(time: Column, dt_: Column | None = None, length: Column | None = None) -> Column:
    """time + dt * length; the time itself where either is absent."""
    return time if dt_ is None or length is None else time + dt_.cast("long") * length.cast("long")


def time_to_samples(time: Column, dt_: Column) -> Column:
    return F.floor(time / dt_)


def samples_to_time(samples: Column, dt_: Column) -> Column:
    return samples * dt_


def absolute_ns(relative: Column, epoch_ns: Column | int, unit: str = "ns") -> Column:
    epoch = epoch_ns if isinstance(epoch_ns, Column) else F.lit(epoch_ns)
    return epoch + (relative * F.lit(PS[unit] // 1000) if PS[unit] >= 1000 else F.floor(relative / 1000))


def relative_from_absolute(absolute: Column, epoch_ns: Column | int, unit: str = "ns") -> Column:
    """Ticks of a unit since the epoch, rounded down."""
    delta = absolute - (epoch_ns if isinstance(epoch_ns, Column) else F.lit(epoch_ns))
    return delta * 1000 if unit == "ps" else F.floor(delta / F.lit(PS[unit] // 1000))


def human_time(ps: Column) -> Column:
    """Largest unit of which there is at least one, with three decimals."""
    out = F.concat(F.format_number(ps, 0), F.lit(" ps"))
    for unit in ("ns", "us", "ms", "s"):
        out = F.when(F.abs(ps) >= PS[unit], F.concat(F.format_number(ps / PS[unit], 3), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_bytes(size: Column) -> Column:
    out = F.concat(F.format_number(size, 0), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**k, F.concat(F.format_number(size / 1024**k, 2), F.lit(f" {unit}"))).otherwise(out)
    return out


#: Forms in which file names carry a start of run.
_DATES = [
    re.compile(r"(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)[T_ ](?P<H>\d\d)[-:](?P<M>\d\d)[-:](?P<S>\d\d)"),
    re.compile(r"(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)[T_-]?(?P<H>\d\d)(?P<M>\d\d)(?P<S>\d\d)"),
    re.compile(r"(?P<y>\d{4})[-_](?P<m>\d\d)[-_](?P<d>\d\d)"),
    re.compile(r"(?<!\d)(?P<y>20\d\d)(?P<m>\d\d)(?P<d>\d\d)(?!\d)"),
]


def epoch_from_name(name: str) -> int | None:
    """ns since 1970 (UTC) of the first date in a file name; ten- or thirteen-digit Unix times count too."""
    for rx in _DATES:
        if m := rx.search(name):
            p = {k: int(v) for k, v in m.groupdict().items()}
            try:
                at = dt.datetime(p["y"], p["m"], p["d"], p.get("H", 0), p.get("M", 0), p.get("S", 0), tzinfo=dt.UTC)
            except ValueError:
                continue
            return int(at.timestamp()) * 1_000_000_000
    if m := re.search(r"(?<!\d)(1\d{9})(\d{3})?(?!\d)", name):
        return int(m[1]) * 1_000_000_000 + int(m[2] or 0) * 1_000_000
    return None
