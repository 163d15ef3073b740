"""Header text, gain strings, checksum lines and listings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import numeric_first


def header_record(text: Column) -> Column:
    """A struct of a header's record line, signal lines and comments; lines that are blank count for nothing.

    First line: name, leads, rate, samples. Then a line a lead, its file first and its name last. Comments are '#key: value'.
    """
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda s: F.trim(s)), lambda l: l != "")
    plain = F.filter(lines, lambda l: ~l.startswith("#"))
    comments = F.filter(lines, lambda l: l.startswith("#") & l.contains(":"))
    first = F.split(F.get(plain, F.lit(0)), r"\s+")
    count = F.get(first, F.lit(1)).try_cast("int")
    leads = F.transform(F.slice(plain, F.lit(2), F.greatest(F.coalesce(count, F.lit(0)), F.lit(0))), lambda l: F.split(l, r"\s+"))
    key = lambda l: F.lower(F.trim(F.regexp_extract(l, r"^#\s*([^:]*):", 1)))
    value = lambda l: F.trim(F.regexp_extract(l, r"^#[^:]*:(.*)$", 1))
    comment = lambda *names: F.get(F.transform(F.filter(comments, lambda l: key(l).isin(*names)), value), F.lit(0))
    codes = F.filter(F.transform(F.split(F.coalesce(comment("dx", "diagnosis"), F.lit("")), ","), lambda s: F.trim(s)), lambda c: c != "")
    return F.struct(
        F.get(first, F.lit(0)).alias("record"), count.alias("leads"), F.get(first, F.lit(2)).try_cast("double").alias("rate"),
        F.get(first, F.lit(3)).try_cast("long").alias("samples"), F.get(F.get(leads, F.lit(0)), F.lit(0)).alias("signal_file"),
        F.get(F.get(leads, F.lit(0)), F.lit(1)).alias("signal_format"), F.transform(leads, lambda l: F.element_at(l, -1)).alias("lead_names"),
        comment("age").alias("age"), comment("sex").alias("sex"), numeric_first(codes).alias("diagnoses"), F.sha2(text, 256).alias("digest"),
    )


def flat(values: Column) -> Column:
    return F.array_join(values, "|")


def gain_parts(spec: Column) -> Column:
    """gain(baseline)/unit; the baseline is 0 and the unit mV where not given."""
    part = lambda k: F.regexp_extract(spec, r"^([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)(?:\(([-+]?\d+)\))?(?:/(\S+))?$", k)
    return F.struct(
        F.nullif(part(1), F.lit("")).try_cast("double").alias("gain"), F.coalesce(F.nullif(part(2), F.lit("")), F.lit("0")).try_cast("int").alias("baseline"),
        F.coalesce(F.nullif(part(3), F.lit("")), F.lit("mV")).alias("unit"),
    )


def checksum_line(line: Column) -> Column:
    halves = F.split(F.trim(line), r"\s+", 2)
    return F.struct(F.lower(F.get(halves, F.lit(0))).alias("digest"), F.regexp_replace(F.get(halves, F.lit(1)), r"^\*?(\./)?", "").alias("path"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def listing_links(html: Column) -> Column:
    """Targets of the links of a listing page."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"?]+)"'), F.lit(1))


def record_name(number: Column, prefix: str = "HR", width: int = 5) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))
