"""Decision curves: net benefit over a grid of thresholds, where it beats the defaults, and runs of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar

GRID = [round(i / 100, 2) for i in range(1, 51)]


def steps_reached(p: Column, grid: Sequence[float]) -> Column:
    """How many of the rising thresholds p reaches, by halving the grid: comparisons that compile, where a filter over an array is interpreted row by row."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(p >= F.lit(float(grid[middle])), among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(grid))


def decision_curve(df: DataFrame, keys: Sequence[str], grid: list[float] = GRID) -> DataFrame:
    """keys, t, tp, fp, n, pos, net_benefit, treat_all, gain over the better default.

    A row adds to one step of the grid, and counts at a threshold are the sums from there up; no row meets all thresholds.
    """
    hist = df.groupBy(*keys, steps_reached(F.col("p"), grid).alias("step")).agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    ends = F.transform(F.sequence(F.lit(0), F.lit(len(grid))), lambda i: i)
    frame = hist.select(*keys).distinct().select(*keys, F.explode(ends).alias("step")).join(hist, [*keys, "step"], "left").na.fill(0, ["a", "b"])
    up = W.partitionBy(*keys).orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys)
    rows = frame.select(
        *keys, "step", F.sum("a").over(up).alias("tp"), F.sum("b").over(up).alias("fp"), F.sum("a").over(whole).alias("pos"),
        (F.sum("a").over(whole) + F.sum("b").over(whole)).alias("n"),
    ).where("step > 0").withColumn("t", F.array(*[F.lit(t) for t in grid])[F.col("step") - 1])
    tp, fp, n, t, pos = (F.col(c) for c in ("tp", "fp", "n", "t", "pos"))
    rows = rows.withColumn("net_benefit", scalar.net_benefit(tp, fp, n, t)).withColumn("treat_all", scalar.treat_all(pos, n, t))
    return rows.withColumn("gain", F.col("net_benefit") - F.greatest("treat_all", F.lit(0.0)))


def superior_range(curve: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """keys, points where the gain is above tolerance, their first and last threshold, whether they are one run, and the best."""
    good = F.col("gain") > tolerance
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("gain"), "t"))
    return curve.withColumn("r", best).groupBy(*keys).agg(
        F.count_if(good).alias("points"), F.min(F.when(good, F.col("t"))).alias("first_t"), F.max(F.when(good, F.col("t"))).alias("last_t"),
        F.coalesce(F.max(F.when(good, F.col("step"))) - F.min(F.when(good, F.col("step"))) + 1 == F.count_if(good), F.lit(False)).alias("contiguous"),
        F.max(F.when(F.col("r") == 1, F.col("t"))).alias("best_t"), F.max("gain").alias("best_gain"),
    )


def threshold_basis(df: DataFrame, keys: Sequence[str], thresholds: Sequence[float], cluster: str = "cluster_id") -> DataFrame:
    """keys, t, cluster, tp, fp, pos, n: what net benefit at a few thresholds needs of each cluster. Rows meet len(thresholds) of them."""
    rows = df.withColumn("t", F.explode(F.array(*map(F.lit, thresholds))))
    flag = (F.col("p") >= F.col("t")).cast("int")
    return rows.groupBy(*keys, "t", cluster).agg(
        F.sum(flag * F.col("y")).alias("tp"), F.sum(flag * (1 - F.col("y"))).alias("fp"), F.sum("y").alias("pos"), F.count("*").alias("n")
    )


def from_basis(sums: DataFrame) -> DataFrame:
    """Adds net_benefit and gain over the better default to sums tp, fp, pos, n at t."""
    tp, fp, pos, n, t = (F.col(c) for c in ("tp", "fp", "pos", "n", "t"))
    rows = sums.withColumn("net_benefit", scalar.net_benefit(tp, fp, n, t))
    return rows.withColumn("gain", F.col("net_benefit") - scalar.better_default(pos, n, t))


def attach(grid: DataFrame, extra: DataFrame, at: str, digits: int = 6, keys: Sequence[str] = ()) -> DataFrame:
    """grid with extra's columns where their points meet, by keys, else null; every point of extra is in the grid exactly once."""
    from .expect import nothing, unique

    key = F.round(at, digits).alias("grid_key")
    left, right = grid.withColumn("grid_key", key), extra.select(key, *[c for c in extra.columns if c != at])
    on = [*keys, "grid_key"]
    unique(left, on), unique(right, on)
    nothing(right.join(left, on, "left_anti").select(*on), "not in the grid")
    return left.join(right, on, "left").drop("grid_key")
