"""Calibration: equal-width and equal-mass error, reliability tables, Brier score, likelihood."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import binary_nll
from .discrimination import quantiles

BINS = 15


def bin_index(p: Column, bins: int = BINS) -> Column:
    """Left-closed equal-width bins from 0; 1 belongs to the last."""
    return F.least(F.width_bucket(p, F.lit(0.0), F.lit(1.0), F.lit(bins)).cast("int") - 1, F.lit(bins - 1))


def bin_totals(df: DataFrame, keys: Sequence[str], bins: int = BINS, weight: str | None = None, index: Column | None = None) -> DataFrame:
    """keys, bin, n, sum_y, sum_p, sum_sq: the basis that weights and resamples multiply."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sq = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    return df.groupBy(*keys, (bin_index(F.col("p"), bins) if index is None else index).alias("bin")).agg(
        F.sum(w).alias("n"), F.sum(w * F.col("y")).alias("sum_y"), F.sum(w * F.col("p")).alias("sum_p"), F.sum(w * sq).alias("sum_sq")
    )


def bin_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """bin_totals() of every row by itself, for sums that are weighted by row or cluster: nothing is grouped before it is dealt."""
    y, p = F.col("y").cast("double"), F.col("p")
    return df.select(*keys, bin_index(p).alias("bin"), F.lit(1.0).alias("n"), y.alias("sum_y"), p.alias("sum_p"), ((p - y) * (p - y)).alias("sum_sq"))


def from_totals(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ece, brier, n from bin totals."""
    gap = F.abs(F.col("sum_y") - F.col("sum_p"))
    return totals.groupBy(*keys).agg(
        F.try_divide(F.sum(gap), F.sum("n")).alias("ece"), F.try_divide(F.sum("sum_sq"), F.sum("n")).alias("brier"), F.sum("n").alias("n")
    )


def calibration(df: DataFrame, keys: Sequence[str], bins: int = BINS, weight: str | None = None) -> DataFrame:
    return from_totals(bin_totals(df, keys, bins, weight), keys)


def calibration_summary(df: DataFrame, keys: Sequence[str], label: str = "label", bins: int = BINS) -> DataFrame:
    """keys, macro_ece, macro_brier, pooled_ece, pooled_brier, labels; bins are summed once for both."""
    by_label = bin_totals(df, [*keys, label], bins)
    pooled = by_label.groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in ("n", "sum_y", "sum_p", "sum_sq")])
    macro = from_totals(by_label, [*keys, label]).groupBy(*keys).agg(F.avg("ece").alias("macro_ece"), F.avg("brier").alias("macro_brier"), F.count("ece").alias("labels"))
    pooled = from_totals(pooled, keys).select(*keys, F.col("ece").alias("pooled_ece"), F.col("brier").alias("pooled_brier"))
    return macro.join(pooled, list(keys))


def reliability(df: DataFrame, keys: Sequence[str], label: str = "label", bins: int = BINS) -> DataFrame:
    """Every bin of every label and of all labels together ('pooled'), empty ones with count 0 and null means."""
    spark = df.sparkSession
    totals = bin_totals(df, [*keys, label], bins)
    sums = [F.sum(c).alias(c) for c in ("n", "sum_y", "sum_p")]
    both = totals.select(*keys, label, "bin", "n", "sum_y", "sum_p").unionByName(
        totals.groupBy(*keys, "bin").agg(*sums).withColumn(label, F.lit("pooled"))
    )
    # Fixed: one row a bin.
    scaffold = both.select(*keys, label).distinct().join(F.broadcast(spark.range(bins).select(F.col("id").cast("int").alias("bin"))), F.lit(True))
    rows = scaffold.join(both, [*keys, label, "bin"], "left")
    return rows.select(
        *keys, label, "bin", (F.col("bin") / F.lit(float(bins))).alias("low"), ((F.col("bin") + 1) / F.lit(float(bins))).alias("high"),
        # To nine digits, so that a mean does not hang on the order in which scores were added.
        F.coalesce("n", F.lit(0.0)).cast("long").alias("count"), F.try_divide(F.round("sum_p", 9), F.col("n")).alias("mean_p"), F.try_divide("sum_y", "n").alias("rate"),
    )


def mean_nll(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(binary_nll(F.col("y"), F.col("p"))).alias("nll"))


def equal_mass_bins(df: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """Adds bin: quantile bins whose equal edges are merged, so tied scores stay together."""
    edges = quantiles(df, keys, "p", [k / bins for k in range(1, bins)]).select(*keys, F.array_distinct("q").alias("edges"))
    return df.join(edges, list(keys)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("p")))).drop("edges")


def equal_mass_calibration(df: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    return from_totals(bin_totals(equal_mass_bins(df, keys, bins), keys, index=F.col("bin")), keys)


def constant_floor(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Calibration of the predictor that says each label's prevalence."""
    rates = df.groupBy(*keys, label).agg(F.avg("y").alias("p"))
    return calibration_summary(df.drop("p").join(rates, [*keys, label]), keys, label)


def shares(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds share: the value's part of its keys' total."""
    return df.withColumn("share", F.try_divide(F.col(value), F.sum(value).over(W.partitionBy(*keys))))
