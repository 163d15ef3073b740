"""Signals: moments, audits, windows and standardization as array expressions; filters and peaks in tasks.

A record's signal is array<array<float>>, a lead at a time. What arrays can say stays in the JVM; the filter and the peak search
of one record are small NumPy helpers, called batch by batch. Beat features are in beats.py.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import window_starts

LEADS = ("I", "II", "III", "AVR", "AVL", "AVF", "V1", "V2", "V3", "V4", "V5", "V6")


def lead_moments(df: DataFrame, signal: str = "signal") -> DataFrame:
    """lead, n, mean, sd (population), low, high: sums by lead, combined before the shuffle."""
    leads = df.select(F.posexplode(signal).alias("lead", "x"))
    d = lambda x: x.cast("double")
    per = leads.select(
        "lead", F.size("x").alias("n"), F.aggregate("x", F.lit(0.0), lambda a, v: a + d(v)).alias("s"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + d(v) * d(v)).alias("q"), F.array_min("x").alias("low"), F.array_max("x").alias("high"),
    )
    total = per.groupBy("lead").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("low").alias("low"), F.max("high").alias("high"))
    mean = F.col("s") / F.col("n")
    return total.select("lead", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"), "low", "high")


def audit(df: DataFrame, record: str, signal: str = "signal") -> DataFrame:
    """One row: records, samples, finite samples, extremes and the record of the largest absolute value."""
    flat = df.select(record, F.flatten(signal).alias("x"))
    fine = F.filter("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    flat = flat.select(record, F.size("x").alias("n"), fine.alias("x"))
    peak = F.array_max(F.transform("x", lambda v: F.abs(v)))
    return flat.agg(
        F.count("*").alias("records"), F.sum("n").alias("samples"), F.sum(F.size("x")).alias("finite"), F.min(F.array_min("x")).alias("low"),
        F.max(F.array_max("x")).alias("high"), F.max_by(record, F.struct(peak, -F.col(record))).alias("peak_record"),
    )


def standardize(signal: Column, mean: list[float], sd: list[float]) -> Column:
    m, s = (F.array(*[F.lit(float(v)) for v in x]) for x in (mean, sd))
    return F.transform(signal, lambda lead, i: F.transform(lead, lambda v: (v - F.get(m, i)) / F.get(s, i)))


def windows(df: DataFrame, length: int, width: int, count: int, signal: str = "signal") -> DataFrame:
    """A row for each of count equidistant, possibly overlapping windows."""
    starts = F.array(*[F.lit(s) for s in window_starts(length, width, count)])
    rows = df.withColumn("start", F.explode(starts))
    return rows.withColumn(signal, F.transform(signal, lambda lead: F.slice(lead, F.col("start") + 1, width)))


def hashed_crop(df: DataFrame, length: int, width: int, seed: int, epoch: int, record: str, signal: str = "signal") -> DataFrame:
    """One window a record whose start is a hash of seed, epoch and record."""
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(record)), F.lit(length - width + 1)).cast("int")
    return df.withColumn("start", start).withColumn(signal, F.transform(signal, lambda lead: F.slice(lead, F.col("start") + 1, width)))


def physical(digital: Column, gain: Column, baseline: Column) -> Column:
    """(digital - baseline) / gain, lead by lead."""
    return F.transform(digital, lambda lead, i: F.transform(lead, lambda v: (v - F.get(baseline, i)) / F.get(gain, i)))


def valid_leads(leads: Column, gains: Column, units: Column, samples: Column, rate: Column) -> Column:
    """Twelve leads in order, millivolts, positive gains, ten seconds."""
    return (
        (F.transform(leads, F.upper) == F.array(*[F.lit(x) for x in LEADS])) & F.forall(gains, lambda g: g > 0)
        & F.forall(units, lambda u: F.lower(u) == "mv") & (samples == rate * 10)
    )


def decode_int16(df: DataFrame, content: str = "content", leads: int = 12) -> DataFrame:
    """Little-endian 16-bit samples, leads interleaved, as array<array<int>> lead by lead."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.frombuffer(raw.as_py(), "<i2").reshape(-1, leads).T.astype(np.int32).tolist() for raw in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.list_(pa.int32())))], [*b.schema.names, "digital"])

    from pyspark.sql.types import StructType

    at = df.columns.index(content)
    return df.mapInArrow(task, StructType([*df.schema.fields, *StructType.fromDDL("digital array<array<int>>").fields]))


def read_matrix(raw: bytes) -> np.ndarray:
    """The first matrix of a version 4 MATLAB file."""
    kind, rows, columns, imaginary, name = np.frombuffer(raw[:20], "<i4")
    if imaginary or kind // 1000:
        raise ValueError("only real little-endian matrices")
    types = {0: "<f8", 1: "<f4", 2: "<i4", 3: "<i2", 4: "<u2", 5: "u1"}
    data = np.frombuffer(raw[20 + name :], types[kind // 10 % 10], count=rows * columns)
    return data.reshape(columns, rows).T


def lowpass(taps: int, cutoff: float) -> np.ndarray:
    """Windowed sinc of unit gain; cutoff in cycles a sample."""
    n = np.arange(taps) - (taps - 1) / 2
    h = 2 * cutoff * np.sinc(2 * cutoff * n) * np.hamming(taps)
    return h / h.sum()


def decimate(x: np.ndarray, factor: int) -> np.ndarray:
    """Every factor-th sample after a low-pass over mirrored edges."""
    taps = 20 * factor + 1
    wide = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(taps // 2, taps // 2)], mode="reflect")
    h = lowpass(taps, 0.5 / factor * 0.9)
    return np.apply_along_axis(lambda v: np.convolve(v, h, mode="valid"), -1, wide)[..., ::factor]


def bandpass(x: np.ndarray, low: float, high: float, rate: float) -> np.ndarray:
    """Zero-phase band-pass of the last axis: gain of a second-order Butterworth applied forwards and backwards, in the frequency domain over mirrored edges."""
    n = x.shape[-1]
    pad = min(n - 1, int(2 * rate))
    # Mirrored by hand and turned round about the ends, as numpy's pad takes longer than the transforms.
    wide = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1) if pad > 0 else x
    return np.fft.irfft(np.fft.rfft(wide) * band_gain(wide.shape[-1], low, high, rate), wide.shape[-1])[..., pad : pad + n]


@lru_cache(64)
def band_gain(n: int, low: float, high: float, rate: float) -> np.ndarray:
    f = np.fft.rfftfreq(n, 1 / rate)
    gain = np.ones_like(f)
    if low > 0:
        gain *= np.divide(f**4, f**4 + low**4)
    if high < rate / 2:
        gain *= 1 / (1 + (f / high) ** 4)
    return gain


def moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    """Centred, over mirrored edges."""
    wide = np.pad(x, (width // 2, width - 1 - width // 2), mode="symmetric")
    total = np.cumsum(np.r_[0.0, wide])
    return (total[width:] - total[:-width]) / width


def spaced_peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Local maxima above a height, higher ones first, none closer than distance to one that is kept."""
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= height)) + 1
    free, kept = np.ones(len(x), bool), []
    for i in at[np.argsort(-x[at], kind="stable")].tolist():
        if free[i]:
            kept.append(i)
            free[max(0, i - distance + 1) : i + distance] = False
    return np.array(sorted(kept), int)


def r_peaks(x: np.ndarray, rate: float) -> np.ndarray:
    """Beats by the energy of the band-passed slope, moved to the largest deflection nearby."""
    band = bandpass(x, 5.0, 20.0, rate)
    energy = moving_mean(np.gradient(band) ** 2, max(3, int(0.12 * rate)))
    if not np.any(energy > 0):
        return np.empty(0, int)
    height = 0.3 * np.percentile(energy, 98)
    found = spaced_peaks(energy, height, int(0.3 * rate))
    reach = int(0.08 * rate)
    out = [max(0, i - reach) + int(np.argmax(np.abs(band[max(0, i - reach) : i + reach + 1]))) for i in found]
    return np.unique(np.array(out, int))


def score_records(df: DataFrame, record: str, labels: list[str], scorer, signal: str = "signal", length: int = 1000, width: int = 250, count: int = 10) -> DataFrame:
    """record, label, p: the mean over equidistant windows of a scorer's probabilities.

    scorer takes a float32 array [windows, leads, width] and gives [windows, labels]; it is any Python callable.
    """
    starts = window_starts(length, width, count)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0), np.array(b.column(1).to_pylist(), np.float32)
            if not len(ids):
                continue
            cut = np.stack([x[:, :, s : s + width] for s in starts], axis=1).reshape(-1, x.shape[1], width)
            p = np.asarray(scorer(cut), float).reshape(len(ids), len(starts), len(labels)).mean(axis=1)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(np.arange(len(ids)), len(labels)))), pa.array(labels * len(ids)), pa.array(p.ravel())], [record, "label", "p"]
            )

    return df.select(record, signal).mapInArrow(task, f"{record} {dict(df.dtypes)[record]}, label string, p double")
