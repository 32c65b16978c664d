"""Column functions on a waveform array. All stay in the JVM; none changes the number of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def window(wave: Column, start, end=None) -> Column:
    """Samples [start, end), bounds clamped to the record; end None: to its end."""
    start = F.greatest(F.lit(0), start if isinstance(start, Column) else F.lit(start)).cast("int")
    end = F.size(wave) if end is None else F.least(end if isinstance(end, Column) else F.lit(end), F.size(wave)).cast("int")
    return F.slice(wave, start + 1, F.greatest(end - start, F.lit(0)))


def mean(wave: Column, start, end=None) -> Column:
    """Mean of a window; NaN if it is empty."""
    w = window(wave, start, end)
    return F.when(F.size(w) > 0, total(w) / F.greatest(F.size(w), F.lit(1))).otherwise(F.lit(NAN))


def normalized(wave: Column, baseline: Column, polarity: Column) -> Column:
    """wave - baseline with positive pulses turned over, so that pulses go down."""
    sign = F.when(polarity == "positive", -1.0).otherwise(1.0)
    return F.transform(wave, lambda x: (x.cast("double") - baseline) * sign)


def pulse(wave: Column, baseline: Column, polarity: Column) -> Column:
    """The signal with pulses upwards: wave - baseline if positive, else baseline - wave."""
    sign = F.when(polarity == "positive", 1.0).otherwise(-1.0)
    return F.transform(wave, lambda x: (x.cast("double") - baseline) * sign)


def height(wave: Column, baseline: Column, polarity: Column, start: int = 40, end: int | None = 90) -> Column:
    w = window(wave, start, end)
    value = F.when(polarity == "positive", F.array_max(w).cast("double") - baseline).otherwise(baseline - F.array_min(w).cast("double"))
    return F.coalesce(value, F.lit(0.0))


def amplitude(wave: Column, start: int = 40, end: int | None = 90) -> Column:
    w = window(wave, start, end)
    return F.coalesce(F.array_max(w).cast("double") - F.array_min(w).cast("double"), F.lit(0.0))


def area(wave: Column, baseline: Column, polarity: Column, start: int = 0, end: int | None = None) -> Column:
    return total(pulse(window(wave, start, end), baseline, polarity))


def max_abs_diff(wave: Column) -> Column:
    steps = F.zip_with(F.slice(wave, 1, F.greatest(F.size(wave) - 1, F.lit(0))), F.slice(wave, 2, F.greatest(F.size(wave) - 1, F.lit(0))), lambda a, b: F.abs(b.cast("double") - a.cast("double")))
    return F.coalesce(F.array_max(steps), F.lit(0.0))


def cumulative(a: Column) -> Column:
    """Running sums, in one pass."""
    return F.aggregate(a, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + x)))


def first_at_least(sums: Column, level: Column) -> Column:
    """Index of the first running sum that reaches the level (of non-negative parts, so sums ascend)."""
    return F.size(F.filter(sums, lambda s: s < level))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once a row: the optimizer would put a column's expression in each place that names it."""
    return F.get(F.transform(F.array(value), use), 0)


def runs(flags: Column) -> Column:
    """[start, end) of the runs of true, as an array of structs, in order."""

    def found(f: Column) -> Column:
        index = F.sequence(F.lit(0), F.size(f))
        at = lambda i: F.coalesce(F.get(f, i), F.lit(False))
        starts = F.filter(index, lambda i: at(i) & ~at(i - 1))
        ends = F.filter(index, lambda i: ~at(i) & at(i - 1))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))

    return let(flags, found)


def argmax(a: Column) -> Column:
    """Index of the first largest value; null if empty."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)).cast("int") - 1)
