"""Scalar expressions: clipped logits, recalibration maps, odds and benefit, bands, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clips of probabilities and of prevalences.
CLIP = 1e-7
PREVALENCE_CLIP = 1e-6


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logit(p: Column, eps: float = CLIP) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (F.lit(1.0) - q))


def expit(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def temperature_scaled(p: Column, temperature: Column | float) -> Column:
    return expit(logit(p) / (F.lit(temperature) if isinstance(temperature, float) else temperature))


def temperature_scaled_float32(p: Column, temperature: float) -> Column:
    """The same through single-precision storage before and after."""
    return temperature_scaled(p.cast("float").cast("double"), temperature).cast("float").cast("double")


def affine(p: Column, slope: Column, offset: Column) -> Column:
    """Slope and offset on the logit; where no parameters are given the probability stays."""
    return F.coalesce(expit(slope * logit(p) + offset), p)


def prior_shift_offset(source: Column, target: Column) -> Column:
    return logit(target, PREVALENCE_CLIP) - logit(source, PREVALENCE_CLIP)


def binary_nll(y: Column, p: Column) -> Column:
    q = clip(p, CLIP, 1 - CLIP)
    return -(y * F.log(q) + (F.lit(1.0) - y) * F.log1p(-q))


def stable_nll(y: Column, z: Column) -> Column:
    """Negative log-likelihood of a logit without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z


def nll_gradient(y: Column, z: Column) -> Column:
    """Of stable_nll() by its logit."""
    return expit(z) - y


def odds(t: Column) -> Column:
    return t / (F.lit(1.0) - t)


def net_benefit(tp: Column, fp: Column, n: Column, t: Column) -> Column:
    return tp / n - fp / n * odds(t)


def treat_all(pos: Column, n: Column, t: Column) -> Column:
    return pos / n - (n - pos) / n * odds(t)


def better_default(pos: Column, n: Column, t: Column) -> Column:
    return F.greatest(treat_all(pos, n, t), F.lit(0.0))


def bbse_prevalence(flagged: Column, tpr: Column, fpr: Column) -> Column:
    """Prevalence from a hard rule's flag rate; null where the rule tells nothing."""
    return F.when(tpr != fpr, clip(F.try_divide(flagged - fpr, tpr - fpr), 0.0, 1.0))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def axis_degrees(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def log2_ratio(a: Column, b: Column) -> Column:
    return F.abs(F.log2(F.try_divide(a, b)))


def window_starts(length: int, width: int, count: int) -> list[int]:
    """Equidistant starts, halves rounded to even."""
    if count == 1:
        return [0]
    step = (length - width) / (count - 1)
    return [round(i * step) for i in range(count)]


def age_band(age: Column) -> Column:
    """Under 40, 40 to under 65, 65 and over; what is no number is unknown."""
    a = age.try_cast("double")
    return (
        F.when(a.isNull() | F.isnan(a), "unknown").when(a < 40, "under_40").when(a < 65, "40_to_64").otherwise("65_plus")
    )


def age_band_strict(age: Column) -> Column:
    """The eligibility tables' rule: negative ages are unknown too."""
    return F.when(age.try_cast("double") < 0, "unknown").otherwise(age_band(age))


def sex_name(code: Column, zero: str = "male", one: str = "female") -> Column:
    """0 and 1, or the words in any case; the eligibility tables' rule swaps the numbers."""
    s = F.lower(F.trim(code.cast("string")))
    return (
        F.when(s.isin("male", "m"), "male").when(s.isin("female", "f"), "female")
        .when(s.isin("0", "0.0"), zero).when(s.isin("1", "1.0"), one).otherwise("unknown")
    )


def has_code(codes: Column, wanted: list[str], separator: str = r"\|") -> Column:
    """Whole-code membership in pipe text; null text has none."""
    return F.arrays_overlap(F.split(F.coalesce(codes, F.lit("")), separator), F.array(*[F.lit(c) for c in wanted]))


def numeric_first(codes: Column) -> Column:
    """Distinct codes, numbers in numeric order before the rest in text order."""
    number = lambda c: c.try_cast("bigint")
    key = lambda c: F.struct(number(c).isNull().alias("t"), number(c).alias("n"), c.alias("c"))
    return F.transform(F.array_sort(F.transform(F.array_distinct(codes), key)), lambda s: s["c"])


def display_name(value: Column, names: dict[str, str]) -> Column:
    """A name for show; values without one are shown as they are."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, value), value)
