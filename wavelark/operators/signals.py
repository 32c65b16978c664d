"""Digital filters on waveforms, per record, by NumPy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def savgol(x: np.ndarray, window: int = 11, order: int = 2) -> np.ndarray:
    """Least-squares polynomial smoothing; the ends take the polynomial of the outermost window. Windows are made odd and no longer than x; unchanged where the order needs more."""
    window = window + 1 if window % 2 == 0 else window
    if len(x) < window:
        window = len(x) if len(x) % 2 else len(x) - 1
    if window <= order or window < 1:
        return x.astype(np.float64)
    half = window // 2
    powers = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    project = powers @ np.linalg.pinv(powers)
    out = np.convolve(x, project[half][::-1], mode="same")
    out[:half] = project[:half] @ x[:window]
    out[-half:] = project[half + 1 :] @ x[-window:] if half else out[-half:]
    return out


def butter_sections(order: int, low: float, high: float, rate: float) -> np.ndarray:
    """Second-order sections b0 b1 b2 1 a1 a2 of a band-pass of the given order: analogue prototype, band transform, bilinear map."""
    if not 0 < low < high < rate / 2:
        raise ValueError("0 < lowcut < highcut < half the sampling rate")
    warp = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, centre2 = warp[1] - warp[0], warp[0] * warp[1]
    k = np.arange(1, order + 1)
    proto = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(proto**2 - centre2 + 0j)
    analogue = np.concatenate((proto + root, proto - root))
    poles = (2 * rate + analogue) / (2 * rate - analogue)
    gain = np.real(width**order * (2 * rate) ** order / np.prod(2 * rate - analogue))
    upper = sorted(poles[poles.imag > 1e-12], key=abs)
    real = sorted(poles[np.abs(poles.imag) <= 1e-12].real)
    pairs = [np.poly([p, p.conj()]).real for p in upper] + [np.poly(real[i : i + 2]) for i in range(0, len(real), 2)]
    sections = np.array([[1, 0, -1, *a] for a in pairs], np.float64)
    sections[0, :3] *= gain
    return sections


def _section(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    z0, z1 = z
    for n, v in enumerate(x):
        y = b[0] * v + z0
        z0, z1 = b[1] * v - a[1] * y + z1, b[2] * v - a[2] * y
        out[n] = y
    return out


def pad_length(sections: np.ndarray) -> int:
    return 3 * (2 * len(sections) + 1 - min(int((sections[:, 2] == 0).sum()), int((sections[:, 5] == 0).sum())))


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forwards and backwards over the signal, extended oddly at both ends and started in the steady state; unchanged where too short."""
    pad = pad_length(sections)
    if len(x) <= pad:
        return x.astype(np.float64)
    ext = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1])).astype(np.float64)

    def once(y: np.ndarray) -> np.ndarray:
        scale = y[0]
        for s in sections:
            b, a = s[:3], s[3:]
            level = b.sum() / a.sum()
            z1 = b[2] - a[2] * level
            z0 = b[1] - a[1] * level + z1
            y = _section(b, a, y, np.array([z0, z1]) * scale)
            scale *= level
        return y

    return once(once(ext)[::-1])[::-1][pad:-pad]


def filter_waveforms(waveforms: DataFrame, filter_type: str = "SG", lowcut: float = 0.1, highcut: float = 0.5, fs: float = 0.5, filter_order: int = 4, sg_window_size: int = 11, sg_poly_order: int = 2, per_channel: Mapping[tuple[int, int], Mapping[str, object]] | None = None) -> DataFrame:
    """The rows with wave filtered to floats; per_channel overrides options by (board, channel). Other columns stay."""
    base = {"filter_type": filter_type, "lowcut": lowcut, "highcut": highcut, "fs": fs, "filter_order": filter_order, "sg_window_size": sg_window_size, "sg_poly_order": sg_poly_order}
    options = {k: base | dict(v) for k, v in (per_channel or {}).items()}
    for o in [base, *options.values()]:
        if o["filter_type"] == "BW":
            butter_sections(o["filter_order"], o["lowcut"], o["highcut"], o["fs"])
        elif o["filter_type"] != "SG":
            raise ValueError("filter_type must be SG or BW")

    def one(wave, o) -> np.ndarray:
        x = np.asarray(wave, np.float64)
        y = savgol(x, o["sg_window_size"], o["sg_poly_order"]) if o["filter_type"] == "SG" else zero_phase(butter_sections(o["filter_order"], o["lowcut"], o["highcut"], o["fs"]), x)
        return y.astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["wave"] = [one(w, options.get((b, c), base)) for w, b, c in zip(pdf["wave"], pdf["board"], pdf["channel"], strict=True)]
            yield pdf

    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.FloatType()), f.nullable) if f.name == "wave" else f for f in waveforms.schema])
    return waveforms.mapInPandas(run, schema)


def wave_pool(records: DataFrame) -> DataFrame:
    """wave_offset by record_id: where each record would start in one flat pool."""
    from .clustering import _join_small
    from pyspark.sql import Window

    b = records.withColumn("__b", F.floor(F.col("record_id") / 200_000))
    carry = b.groupBy("__b").agg(F.sum("event_length").alias("n")).withColumn("__off", F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.coalesce(F.sum("event_length").over(Window.partitionBy("__b").orderBy("record_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _join_small(b, carry, ["__b"]).withColumn("wave_offset", (within + F.col("__off")).cast("long")).drop("__b", "__off")


def filtered_pool(records: DataFrame, **options) -> DataFrame:
    """The pool's records, with wave_offset, each filtered on its own samples alone; one whose event_length isn't that of its wave fails the job."""
    off = F.raise_error(F.concat(F.lit("out of the pool: record "), F.col("record_id"))).cast("boolean")
    exact = records.where(F.when(F.col("event_length").eqNullSafe(F.size("wave")), F.lit(True)).otherwise(off))
    out = filter_waveforms(exact, **options)
    return out if "wave_offset" in out.columns else wave_pool(out)
