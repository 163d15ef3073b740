"""Beat features of twelve-lead records: array expressions over the median beat and its peaks.

A small NumPy helper filters a record, finds its peaks and takes their median beat. Intervals, the beat's bounds and its waves are array
expressions, a record a row: nothing is shuffled, and memory is bounded by a row. A record that is null, has a null or
non-finite sample, uneven leads or other than twelve keeps its row with the failure flags set; what can't be measured is null, never filled in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import axis_degrees
from .signals import LEADS, bandpass, r_peaks

#: Samples of the median beat before and after its peak, and the least variance of a lead that is not flat.
PRE, POST, FLAT = 40, 60, 1e-4
#: Fixed values, in seconds: half width searched for the steepest part, most reach of a bound, width of the resting level and of the envelope's mean.
STEEPEST, REACH, RESTING, SMOOTH = 0.08, 0.14, 0.04, 0.03
#: The bounds' share of the envelope, and the percentile it rises from.
BOUND_SHARE, RISES_FROM = 0.05, 0.2
#: Fixed values of the P wave (seconds searched and left out, least millivolts, share at its onset) and of the T wave.
P_SEARCH, P_GUARD, P_LEAST, P_SHARE = 0.22, 0.03, 0.05, 0.2
T_GUARD, T_SEARCH = 0.04, 0.5
#: Fixed values, in milliseconds: ranges that an interval must lie in.
PR_RANGE, QT_RANGE = (60.0, 400.0), (200.0, 700.0)
#: Leads of the amplitudes.
AMPLITUDES, T_AMPLITUDES = ("I", "AVF", "V1", "V6"), ("II", "V5")
#: Records that a task holds at once beside the batch that Spark hands it, and most bytes of such a batch.
RECORDS, BATCH_BYTES = 16, 1 << 24
#: Names of the features, in order.
FEATURES = (
    "heart_rate_bpm", "rr_standard_deviation_ms", "rr_interquartile_range_ms", "qrs_duration_ms", "frontal_axis_degrees", "frontal_axis_sin", "frontal_axis_cos",
    "pr_interval_ms", "qt_interval_ms", "r_amplitude_i_mv", "s_amplitude_i_mv", "r_amplitude_avf_mv", "s_amplitude_avf_mv", "r_amplitude_v1_mv", "s_amplitude_v1_mv",
    "r_amplitude_v6_mv", "s_amplitude_v6_mv", "t_amplitude_ii_mv", "t_amplitude_v5_mv", "r_peak_detection_failed", "pr_interval_missing", "qt_interval_missing",
)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def array_quantile(x: Column, q: float) -> Column:
    """Linear between neighbours; null of an empty array. sort_array compares natively, array_sort by a lambda."""

    def pick(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(q)
        low, high = F.get(s, F.floor(place).cast("int")), F.get(s, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return let(F.sort_array(x), lambda s: F.when(F.size(s) > 0, pick(s)))


def first_peak(x: Column) -> Column:
    """Place of the largest value, from 0; the first of equals."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def array_mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def level_crossings(x: Column, level: Column) -> Column:
    """Every place where the straight lines between samples cross the level, in order: struct(at, up). A sample at the level counts as above."""

    def on(i: Column) -> Column:
        a, b = F.get(x, i), F.get(x, i + 1)
        return F.when((a < level) != (b < level), F.struct((i + (level - a) / (b - a)).alias("at"), (a < level).alias("up")))

    segments = F.when(F.size(x) > 1, F.sequence(F.lit(0), F.size(x) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_compact(F.transform(segments, on))


def feet(x: Column, level: Column, top: Column) -> Column:
    """struct(left, right): the last crossing upwards before top and the first downwards after it; null where there is none."""
    place = lambda c: c["at"]
    return let(level_crossings(x, level), lambda every: F.struct(
        F.array_max(F.transform(F.filter(every, lambda c: c["up"] & (c["at"] <= top)), place)).alias("left"),
        F.array_min(F.transform(F.filter(every, lambda c: ~c["up"] & (c["at"] >= top)), place)).alias("right"),
    ))


def usable(raw: pa.ListArray | None) -> np.ndarray | None:
    """The leads [lead, sample]; None of a record that can't be used."""
    if raw is None or len(raw) != len(LEADS) or raw.null_count:
        return None
    lengths = set(raw.value_lengths().to_pylist())
    if len(lengths) > 1 or lengths == {0}:
        return None
    x = raw.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(LEADS), -1)
    return x if np.isfinite(x).all() else None


def wave_and_peaks(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The leads without their slow drift, and the peaks of lead II, or of the strongest lead where that is flat."""
    power = bandpass(x, 5.0, 25.0, rate).var(axis=-1)
    rhythm = 1 if power[1] >= FLAT else int(power.argmax())
    peaks = r_peaks(x[rhythm], rate) if power[rhythm] >= FLAT else np.empty(0, int)
    return bandpass(x, 0.5, rate, rate), peaks.astype(np.int32)


def median_beat(wave: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Lead by lead the median over whole beats [lead, sample]; if none is whole, over all, their windows held at the record's ends."""
    n = wave.shape[1]
    whole = peaks[(peaks >= PRE) & (peaks + POST <= n)]
    at = (whole if len(whole) else peaks)[:, None] + np.arange(-PRE, POST)
    beats = np.sort(wave[:, np.clip(at, 0, n - 1)], axis=1)
    low, high = beats[:, (len(at) - 1) // 2], beats[:, len(at) // 2]
    return low + (high - low) * 0.5


def measured(df: DataFrame, record: str, signal: str, column: str, value: Callable[[np.ndarray, np.ndarray], np.ndarray | None], rate: float) -> DataFrame:
    """record, column (an array a lead of what value makes of wave and peaks; null if the record can't be used) and peaks.

    A task holds a batch of at most BATCH_BYTES (or one record), unless the session bounds batches itself, and the values of RECORDS records.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(key)).rstrip("b") == str(1 << 26):
        spark.conf.set(key, str(BATCH_BYTES))

    def one(raw: pa.ListArray | None) -> tuple[list[np.ndarray] | None, np.ndarray]:
        x = usable(raw)
        if x is None:
            return None, np.empty(0, np.int32)
        wave, peaks = wave_and_peaks(x, rate)
        own = value(wave, peaks)
        return None if own is None else list(own), peaks

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, RECORDS):
                b = whole.slice(at, RECORDS)
                found = [one(s.values) for s in b.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([w for w, _ in found], pa.list_(pa.list_(pa.float64()))), pa.array([p for _, p in found], pa.list_(pa.int32()))], [record, column, "peaks"]
                )

    return df.select(record, signal).mapInArrow(task, f"`{record}` {dict(df.dtypes)[record]}, {column} array<array<double>>, peaks array<int>")


def filtered(df: DataFrame, record: str, signal: str, rate: float) -> DataFrame:
    """record, wave (leads without their slow drift; null if the record can't be used) and peaks."""
    return measured(df, record, signal, "wave", lambda wave, peaks: wave, rate)


def median_beats(df: DataFrame, record: str, signal: str, rate: float) -> DataFrame:
    """record, beat (null without peaks) and peaks; waves stay in their task."""
    return measured(df, record, signal, "beat", lambda wave, peaks: median_beat(wave, peaks) if len(peaks) else None, rate)


def envelope(energy: Column, rate: float) -> Column:
    """Moving mean over mirrored ends."""
    width, n = max(1, round(SMOOTH * rate)), F.size(energy)
    mirror = lambda i: F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)
    around = lambda i: sum((F.get(energy, mirror(i + k)) for k in range(-(width // 2), width - width // 2)), F.lit(0.0)) / width
    return F.transform(energy, lambda v, i: around(i))


def window(x: Column, low: Column, high: Column) -> Column:
    """struct(at, v) of the samples from low up to high (not with it); null where they are fewer than four."""
    cells = F.transform(F.sequence(low, high - 1), lambda i: F.struct(i.alias("at"), F.get(x, i).alias("v")))
    return F.when(high - low >= 4, cells)


def largest(cells: Column) -> Column:
    """The cell of the largest deflection either way, the first of equals."""
    ranked = F.array_max(F.transform(cells, lambda c: F.struct(F.abs(c["v"]).alias("size"), (-c["at"]).alias("early"), c["v"].alias("v"))))
    return let(ranked, lambda r: F.struct((-r["early"]).alias("at"), r["v"].alias("v")))


def p_onset(lead: Column, onset: Column, lookback: Column, rate: float) -> Column:
    """Where the P wave leaves the resting level: the foot, at a share of its height, of the largest deflection of the window before the beat.

    Null if the window is short, the deflection is small or at the window's edge, or its foot lies before the window.
    """
    high = F.floor(onset).cast("int") - max(1, round(P_GUARD * rate))
    low = F.greatest(high - lookback, F.lit(0))

    def told(cells: Column) -> Column:
        sizes = F.transform(cells, lambda c: F.abs(c["v"]))
        inside = lambda peak: (peak["at"] > low) & (peak["at"] < high - 1) & (F.abs(peak["v"]) >= P_LEAST)
        return let(largest(cells), lambda peak: F.when(inside(peak), low + feet(sizes, F.abs(peak["v"]) * P_SHARE, (peak["at"] - low).cast("double"))["left"]))

    return F.when(high > low, let(window(lead, low, high), lambda cells: F.when(cells.isNotNull(), told(cells))))


def t_wave(lead: Column, offset: Column, high: Column, rate: float) -> Column:
    """struct(amplitude, end): the largest deflection of the window after the beat, and where the steepest of the tangents back to the
    resting level, one between each two samples after the deflection, meets it; without two such samples or a way back there is no end."""
    low = F.ceil(offset).cast("int") + max(1, round(T_GUARD * rate))

    def told(cells: Column) -> Column:
        def tangents(peak: Column) -> Column:
            def tangent(i: Column) -> Column:
                step = F.get(lead, i + 1) - F.get(lead, i)
                back = -F.signum(peak["v"]) * step
                return F.when(back > 0, F.struct(back.alias("steep"), (-i).alias("early"), (i - F.get(lead, i) / step).alias("meets")))

            return F.when(high - peak["at"] > 2, F.array_max(F.array_compact(F.transform(F.sequence(peak["at"], high - 2), tangent))))

        end = lambda peak: let(tangents(peak)["meets"], lambda at: F.when(at > peak["at"], at))
        return let(largest(cells), lambda peak: F.struct(peak["v"].alias("amplitude"), end(peak).alias("end")))

    return F.when(high > low, let(window(lead, low, high), lambda cells: F.when(cells.isNotNull(), told(cells))))


def with_rhythm(rows: DataFrame, ms: float) -> DataFrame:
    """Adds rr (milliseconds between peaks), its mean and median, and span (samples of a typical beat)."""
    gaps = F.zip_with(F.slice("peaks", 2, F.size("peaks")), F.slice("peaks", 1, F.greatest(F.size("peaks") - 1, F.lit(0))), lambda later, earlier: (later - earlier) * ms)
    rows = rows.withColumn("rr", gaps)
    rows = rows.withColumns({"rr_median": array_quantile(F.col("rr"), 0.5), "rr_mean": F.when(F.size("rr") > 0, array_mean(F.col("rr")))})
    return rows.withColumn("span", F.coalesce(F.col("rr_median") / ms, F.lit(float(POST))))


def with_bounds(rows: DataFrame, rate: float) -> DataFrame:
    """Adds onset and offset of the median beat: the feet of its envelope, at a share of the way from the ground to the top, held within reach.

    The envelope is the smoothed length of the leads' joint step; its top is looked for near the peak, its ground is a low percentile.
    """
    c = F.col
    steps = F.transform(F.sequence(F.lit(0), F.lit(PRE + POST - 1)), lambda t: F.sqrt(F.aggregate("beat", F.lit(0.0), lambda sum_, x: sum_ + F.pow(F.get(x, t) - F.get(x, F.greatest(t - 1, F.lit(0))), 2.0))))
    rows = rows.withColumn("steps", steps).withColumn("envelope", F.when(c("beat").isNotNull(), envelope(c("steps"), rate)))
    near, reach = max(1, round(STEEPEST * rate)), max(1, round(REACH * rate))
    rows = rows.withColumns({"top": first_peak(F.slice("envelope", PRE - near + 1, 2 * near + 1)) + (PRE - near), "ground": array_quantile(c("envelope"), RISES_FROM)})
    height = F.get("envelope", c("top")) - c("ground")
    rows = rows.withColumn("feet", F.when(height > 0, feet(c("envelope"), c("ground") + height * BOUND_SHARE, c("top").cast("double"))))
    held = lambda at, edge, pick: F.when(c("feet").isNotNull(), pick(F.coalesce(at, edge), edge))
    first, last = F.greatest(c("top") - reach, F.lit(0)).cast("double"), F.least(c("top") + reach, F.lit(PRE + POST - 1)).cast("double")
    rows = rows.withColumns({"left": held(c("feet.left"), first, F.greatest), "right": held(c("feet.right"), last, F.least)})
    return rows.withColumns({"onset": F.when(c("left") < c("right"), c("left")), "offset": F.when(c("left") < c("right"), c("right"))})


def at_rest(rows: DataFrame, rate: float) -> DataFrame:
    """The beat with each lead's resting level, its median just before the onset, at zero; null without bounds."""
    ends = F.greatest(F.floor("onset").cast("int"), F.lit(1))
    begins = F.greatest(ends - max(1, round(RESTING * rate)), F.lit(0))
    rest = lambda x: array_quantile(F.slice(x, begins + 1, ends - begins), 0.5)
    return rows.withColumn("beat", F.when(F.col("onset").isNotNull(), F.transform("beat", lambda x: let(rest(x), lambda level: F.transform(x, lambda v: v - level)))))


def feature_table(df: DataFrame, record: str, signal: str = "signal", rate: float = 100.0) -> DataFrame:
    """record and FEATURES; df: record, signal (array<array<double>>, millivolts, a lead at a time in the order of LEADS)."""
    c, ms = F.col, 1000.0 / rate
    lead = lambda name: F.get("beat", F.lit(LEADS.index(name)))
    rows = with_rhythm(median_beats(df, record, signal, rate), ms)
    rows = at_rest(with_bounds(rows, rate), rate)
    start = F.floor("onset").cast("int")
    part = lambda name: F.slice(lead(name), start + 1, F.ceil("offset").cast("int") + 1 - start)
    rows = rows.withColumns({f"part_{n}": part(n) for n in AMPLITUDES})
    area = lambda name: F.aggregate(f"part_{name}", F.lit(0.0), lambda a, v: a + v) / rate
    lookback = F.least(F.lit(round(P_SEARCH * rate)), F.greatest(F.lit(1), F.rint(c("span") * 0.5).cast("int")), F.lit(PRE))
    stop = F.least(F.lit(PRE + POST), F.ceil("offset").cast("int") + round(T_SEARCH * rate), PRE + F.greatest(F.lit(4), F.rint(c("span") * 0.7).cast("int")))
    rows = rows.withColumns({"axis": axis_degrees(area("AVF"), area("I")), "p": p_onset(lead("II"), c("onset"), lookback, rate)} | {f"t_{n}": t_wave(lead(n), c("offset"), stop, rate) for n in T_AMPLITUDES})
    within = lambda v, low, high: F.when(v.between(low, high), v)
    rows = rows.withColumns({"pr": within((c("onset") - c("p")) * ms, *PR_RANGE), "qt": within((c("t_II.end") - c("onset")) * ms, *QT_RANGE)})
    spread = F.sqrt(array_mean(F.transform("rr", lambda v: F.pow(v - c("rr_mean"), 2.0))))
    values = [
        60000.0 / F.when(c("rr_median") > 0, c("rr_median")), F.when(F.size("rr") > 0, spread), array_quantile(c("rr"), 0.75) - array_quantile(c("rr"), 0.25),
        (c("offset") - c("onset")) * ms, c("axis"), F.sin(F.radians("axis")), F.cos(F.radians("axis")), c("pr"), c("qt"),
        *[f for n in AMPLITUDES for f in (F.when(c(f"part_{n}").isNotNull(), F.greatest(F.array_max(f"part_{n}"), F.lit(0.0))), F.when(c(f"part_{n}").isNotNull(), F.least(F.array_min(f"part_{n}"), F.lit(0.0))))],
        *[c(f"t_{n}.amplitude") for n in T_AMPLITUDES], F.when(F.size("rr") > 0, 0.0).otherwise(1.0), c("pr").isNull().cast("double"), c("qt").isNull().cast("double"),
    ]
    return rows.select(record, *[v.alias(f) for v, f in zip(values, FEATURES, strict=True)])
