"""Shift between cohorts: drops, decompositions, standardization, correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drop_table(df: DataFrame, keys: Sequence[str], value: str, internal: str, external: list[str]) -> DataFrame:
    """keys, each cohort's value, the worst external and the drop to it, largest first."""
    wide = df.groupBy(*keys).pivot("cohort", [internal, *external]).agg(F.max(value))
    worst = F.least(*[F.col(e) for e in external]) if len(external) > 1 else F.col(external[0])
    return wide.withColumn("worst", worst).withColumn("drop", F.col(internal) - F.col("worst")).orderBy(F.desc("drop"))


def shapley_sides(both: Column, positives_only: Column, negatives_only: Column, neither: Column) -> tuple[Column, Column]:
    """The positives' and negatives' parts of both - neither, each the mean over the two orders of change."""
    pos = ((positives_only - neither) + (both - negatives_only)) / 2
    neg = ((negatives_only - neither) + (both - positives_only)) / 2
    return pos, neg


def crossed_auroc(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUROC of a's positives against b's negatives: a union and the tie-aware scan, never the pairs."""
    from .discrimination import auroc

    rows = a.where("y = 1").select(*keys, "y", "p").unionByName(b.where("y = 0").select(*keys, "y", "p"))
    return auroc(rows, keys).select(*keys, "auroc")


def standardization_weights(df: DataFrame, target: DataFrame, strata: Sequence[str], cohort: str = "cohort") -> tuple[DataFrame, DataFrame]:
    """df with weight (share of the target's cell over the own cohort's, rescaled to mean 1), and diagnostics by cohort.

    Rows of a cell that the target lacks, or with a missing stratum, get weight null and leave the analysis.
    """
    full = lambda d: d.dropna(subset=list(strata))
    own = full(df).groupBy(cohort, *strata).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(cohort)))
    aim = full(target).groupBy(*strata).agg(F.count("*").alias("n"))
    # One row.
    whole = F.broadcast(aim.agg(F.sum("n").alias("all_n")))
    aim = aim.join(whole, F.lit(True)).select(*strata, (F.col("n") / F.col("all_n")).alias("aim"))
    cells = own.join(aim, list(strata), "left").select(cohort, *strata, (F.col("aim") / F.col("share")).alias("raw"), F.col("n").alias("cell_n"))
    scale = F.sum(F.when(F.col("raw").isNotNull(), F.col("cell_n"))).over(W.partitionBy(cohort)) / F.sum(F.col("raw") * F.col("cell_n")).over(W.partitionBy(cohort))
    cells = cells.withColumn("weight", F.col("raw") * scale)
    rows = df.join(cells.select(cohort, *strata, "weight"), [cohort, *strata], "left")
    w = F.col("weight")
    return rows, rows.groupBy(cohort).agg(
        F.count(w).alias("used"), F.count_if(w.isNull()).alias("left_out"), F.min(w).alias("least"), F.max(w).alias("most"),
        F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)).alias("effective"),
    )


def spearman_ranks(df: DataFrame, keys: Sequence[str], column: str) -> Column:
    """Average ranks as a column: rank and half the ties beyond it."""
    own = W.partitionBy(*keys)
    return F.rank().over(own.orderBy(column)) + (F.count("*").over(W.partitionBy(*keys, column)) - 1) / F.lit(2.0)


def correlations(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, n, pearson, spearman with two-sided p-values."""
    ranked = df.withColumn("rx", spearman_ranks(df, keys, x)).withColumn("ry", spearman_ranks(df, keys, y))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("rx", "ry").alias("spearman"))
    return out.withColumns({"pearson_p": correlation_p(F.col("pearson"), F.col("n")), "spearman_p": correlation_p(F.col("spearman"), F.col("n"))})


def correlation_p(r: Column, n: Column, steps: int = 2000) -> Column:
    """Two-sided p of a correlation by Student's t with n - 2 degrees: the share of sin(u)^(n - 3) over [0, pi / 2] below acos(|r|).

    Both integrals by Simpson's rule over the same number of steps; null below three rows.
    """

    def area(top: Column) -> Column:
        h = top / F.lit(float(steps))
        term = lambda i: F.pow(F.sin(i * h), n - 3) * F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda a, i: a + term(i)) * h / 3

    return F.when((n >= 3) & r.isNotNull() & ~F.isnan(r), F.least(F.lit(1.0), area(F.acos(F.least(F.abs(r), F.lit(1.0)))) / area(F.lit(math.pi / 2))))


def spread(df: DataFrame, keys: Sequence[str], value: str, ensemble: str) -> DataFrame:
    """keys, mean, sample SD and range over members, and the ensemble's gain over the worst and the best."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.max(value) - F.min(value)).alias("spread"),
        (F.max(ensemble) - F.min(value)).alias("gain_over_worst"), (F.max(ensemble) - F.max(value)).alias("gain_over_best"),
    )


def score_separation(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, medians by class, the negatives' 99th percentile and the share of positives below it: all from one count of scores by class."""
    from .discrimination import quantiles_of_counts, value_counts

    counts = value_counts(df, [*keys, "y"], "p")
    found = quantiles_of_counts(counts.where("y in (0, 1)"), [*keys, "y"], [0.5, 0.99])
    own = lambda y, i, name: F.max(F.when(F.col("y") == y, F.col("q")[i])).alias(name)
    limits = found.groupBy(*keys).agg(own(1, 0, "median_pos"), own(0, 0, "median_neg"), own(0, 1, "neg_p99"))
    limits = counts.select(*keys).distinct().join(limits, list(keys), "left")
    seen = F.col("value_").isNotNull() & F.col("neg_p99").isNotNull()
    share = F.try_divide(F.sum(F.when(seen & (F.col("value_") < F.col("neg_p99")), F.col("n")).otherwise(0)), F.sum(F.when(seen, F.col("n"))))
    below = counts.join(limits, list(keys)).where("y = 1").groupBy(*keys).agg(share.alias("pos_below"))
    return limits.join(below, list(keys), "left")
