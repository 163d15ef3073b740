"""Expectations: checks that fail with what they found, each an aggregate or an anti-join that should be empty."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Unmet(ValueError):
    """An expectation does not hold."""


def nothing(df: DataFrame, what: str) -> None:
    found = df.limit(3).collect()
    if found:
        raise Unmet(f"{what}: {[r.asDict() for r in found]}")


def unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    nothing(df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), f"{list(key)} repeats")
    return df


def row_count(df: DataFrame, expected: int) -> DataFrame:
    if (n := df.count()) != expected:
        raise Unmet(f"{n} rows, not {expected}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", complete: bool = True) -> DataFrame:
    """A join whose keys are unique on both sides; with complete, every left row has its partner."""
    unique(left, on), unique(right, on)
    if complete:
        nothing(left.join(right, list(on), "left_anti").select(*on), "no partner")
    return left.join(right, list(on), how)


def same_rows(seen: DataFrame, registered: DataFrame, on: Sequence[str], value: str) -> None:
    """Two count tables agree cell by cell; a cell of one only is a difference."""
    a, b = (d.select(*on, F.col(value).alias(n)) for d, n in ((seen, "seen"), (registered, "registered")))
    nothing(a.join(b, list(on), "full").where(~F.col("seen").eqNullSafe(F.col("registered"))), "counts differ")


def value_counts(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """value, seen, expected, fits of every value that either has; expected: value, expected."""
    seen = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("seen"))
    both = seen.join(expected.select("value", "expected"), "value", "full").na.fill(0, ["seen", "expected"])
    return both.withColumn("fits", F.col("seen") == F.col("expected"))


def prediction_report(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """keys, rows, and how many are null, not finite, out of [0, 1], or not labelled 0 or 1."""
    v = F.col(p)
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(v.isNull()).alias("missing"), F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("not_finite"),
        F.count_if((v < 0) | (v > 1)).alias("out_of_range"), F.count_if(~F.coalesce(F.col(y).isin(0, 1), F.lit(False))).alias("bad_labels"),
    )


def valid_predictions(df: DataFrame, keys: Sequence[str] = ("cohort", "model", "label")) -> DataFrame:
    nothing(prediction_report(df, keys).where("missing + not_finite + out_of_range + bad_labels > 0"), "bad predictions")
    return df


def content_digest(df: DataFrame, columns: Sequence[str]) -> str:
    """Digest of a set of rows whatever their order and partitions: count, and sums of two halves of each row's hash."""
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)
    half = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")
    got = df.agg(F.count("*").alias("n"), F.sum(half(1)).alias("a"), F.sum(half(17)).alias("b")).first()
    return f"{got['n']}-{int(got['a'] or 0):x}-{int(got['b'] or 0):x}"


def file_digests(df: DataFrame) -> DataFrame:
    """path, digest, length of binaryFile rows."""
    return df.select("path", F.sha2("content", 256).alias("digest"), "length")


def bound_inputs(found: DataFrame, manifest: DataFrame) -> None:
    """Every input of the manifest (name, digest) is there with its digest."""
    nothing(manifest.join(found, ["name", "digest"], "left_anti"), "inputs are not the registered ones")


def record_set(df: DataFrame, record: str, count: int, digest: str) -> None:
    if (got := content_digest(df.select(record), [record])) != digest or not got.startswith(f"{count}-"):
        raise Unmet(f"record set {got}")


def vouched(cached: DataFrame, receipt: DataFrame) -> DataFrame:
    """Cached passes whose digest the receipt has; others are to be done again."""
    return cached.join(receipt, ["model", "member", "digest"], "left_semi")


def receipt_update(path: str, choices: str, cohort: str, **passed: str) -> dict:
    """A small JSON state: made, resumed or refused. A finished receipt, or one of other choices, is refused."""
    state = {"cohort": cohort, "choices": choices, "status": "started", "passes": {}}
    if os.path.exists(path):
        with open(path) as f:
            state = json.load(f)
        if state["choices"] != choices or state["cohort"] != cohort:
            raise Unmet("the receipt is of other choices")
        if state["status"] == "done":
            raise Unmet("the cohort was scored already")
    state["passes"] |= passed
    write_json(path, state)
    return state


def receipt_close(path: str) -> None:
    with open(path) as f:
        state = json.load(f)
    write_json(path, state | {"status": "done"})


def write_json(path: str, value: dict) -> None:
    """Through a file beside it, so a reader never sees half."""
    with open(f"{path}.new", "w") as f:
        json.dump(value, f, indent=1, sort_keys=True)
    os.replace(f"{path}.new", path)


def where_all(df: DataFrame, **rules: Column) -> DataFrame:
    """Rows breaking a rule, with the names of the broken rules."""
    broken = F.concat_ws("|", *[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()])
    return df.withColumn("broken", broken).where("broken <> ''")
