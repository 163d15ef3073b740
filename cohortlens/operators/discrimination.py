"""Discrimination: tie-aware AUROC, average precision, F1 thresholds, midranks.

Scores are grouped first, so ties cost nothing; everything before a window is a map-side combined aggregate. Running sums go by
buckets of the score: a window inside each bucket of a key, and a prefix over a key's BUCKETS bucket totals, so a key with many
scores is many tasks. Undefined values are null, never 0 or 0.5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut


def _w(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


#: Score buckets of a key; even in the logit, where most models' scores spread.
BUCKETS = 64


def score_bucket(p: Column, buckets: int = BUCKETS) -> Column:
    """A bucket that never falls as the score rises; scores outside (0, 1) go to the ends. More buckets are narrower, over the same logits."""
    logit = F.log(F.try_divide(p, 1 - p))
    inside = F.least(F.greatest(F.floor(logit * (buckets / 16) + buckets // 2), F.lit(0)), F.lit(buckets - 1))
    return F.when(p <= 0, 0).when(p >= 1, buckets - 1).otherwise(inside).cast("int")


def spread_buckets(counts: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Adds bucket by sampled quantiles of a key's values, for values of any range: equal ones share a bucket, and it never falls as they rise."""
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(p, F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), F.lit(1000)).alias("cuts"))
    rows = counts.join(cuts, list(keys)) if keys else counts.join(F.broadcast(cuts), F.lit(True))
    return rows.withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(p))).cast("int")).drop("cuts")


def running(counts: DataFrame, keys: Sequence[str], columns: dict[str, str], p: str = "p", falling: bool = False) -> DataFrame:
    """counts (distinct keys and p) with running sums of columns up to and with each score, from the top if falling.

    Where counts have a column bucket, as spread_buckets() adds it, that is taken; else scores are dealt by their logit.
    """
    towards = (lambda c: F.desc(c)) if falling else (lambda c: F.asc(c))
    if "bucket" not in counts.columns:
        counts = counts.withColumn("bucket", score_bucket(F.col(p)))
    totals = counts.groupBy(*keys, "bucket").agg(*[F.sum(c).alias(f"all_{c}") for c in columns])
    # At most BUCKETS rows a key
    earlier = W.partitionBy(*keys).orderBy(towards("bucket")).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "bucket", *[F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).alias(f"before_{c}") for c in columns])
    inside = W.partitionBy(*keys, "bucket").orderBy(towards(p)).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = counts.join(totals, [*keys, "bucket"])
    return rows.withColumns({out: F.col(f"before_{c}") + F.sum(c).over(inside) for c, out in columns.items()}).drop("bucket", *[f"before_{c}" for c in columns])


def score_counts(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """keys, p, pos, neg: weight of positives and negatives at each distinct score; -0.0 is 0.0."""
    return df.groupBy(*keys, (F.col(p) + F.lit(0.0)).alias(p)).agg(
        F.sum(_w(weight) * F.col(y)).alias("pos"), F.sum(_w(weight) * (1 - F.col(y))).alias("neg")
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value_, n: how often each value (-0.0 being 0.0, null and NaN values of their own) is there. Written once, since all that follows must see the same rows."""
    return cut(df.groupBy(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("value_")).agg(F.count("*").alias("n")))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """keys, n and q (an entry a prob): exact quantiles with linear interpolation over values neither null nor NaN, from counts of distinct values.

    No key's values meet in one task: counts are summed on the map side and run up by buckets. Keys without values have no row.
    """
    return quantiles_of_counts(value_counts(df, keys, value), keys, probs)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """quantiles() of value_counts().

    The cuts of the buckets hang on the order in which a shuffle brings the parts of a sketch. So the rows are written with their buckets: totals and
    rows of cuts that were made twice would not fit each other.
    """
    counts = counts.where("value_ is not null and not isnan(value_)")
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("n_all"))
    scan = running(cut(spread_buckets(counts, keys, "value_")), keys, {"n": "upto"}, "value_")
    scan = scan.join(totals, list(keys)) if keys else scan.join(F.broadcast(totals), F.lit(True))
    at = [(F.col("n_all") - 1) * F.lit(float(q)) for q in probs]
    reach = lambda i: F.min(F.when(F.col("upto") > i, F.col("value_")))
    ends = [c for i, h in enumerate(at) for c in (reach(F.floor(h)).alias(f"low{i}"), reach(F.floor(h) + 1).alias(f"high{i}"))]
    out = scan.groupBy(*keys, "n_all").agg(*ends)
    between = [F.col(f"low{i}") + (F.coalesce(f"high{i}", f"low{i}") - F.col(f"low{i}")) * (h - F.floor(h)) for i, h in enumerate(at)]
    return out.select(*keys, F.col("n_all").alias("n"), F.array(*between).alias("q"))


def auroc(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", weight: str | None = None, any_range: bool = False) -> DataFrame:
    """keys, auroc, pos, neg; ties count half; null with one class only. any_range: scores are no probabilities, so buckets follow their quantiles."""
    return auroc_of_counts(score_counts(df, keys, y, p, weight), keys, p, any_range)


def auroc_of_counts(counts: DataFrame, keys: Sequence[str], p: str = "p", any_range: bool = False) -> DataFrame:
    """auroc() of rows already summed by key and score (p, pos, neg)."""
    counts = spread_buckets(counts, keys, p) if any_range else counts.withColumn("bucket", score_bucket(F.col(p)))
    inside = W.partitionBy(*keys, "bucket").orderBy(p).rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = counts.withColumn("below", F.sum("neg").over(inside) - F.col("neg"))
    parts = counts.groupBy(*keys, "bucket").agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") * F.lit(0.5))).alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    return from_buckets(parts, keys)


def from_buckets(parts: DataFrame, keys: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """keys, auroc, pos, neg of bucket sums; wins are pairs inside a bucket, half for ties. Columns named in also are summed as they are."""
    earlier = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("wins", F.col("wins") + F.col("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
    return parts.groupBy(*keys).agg(
        F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("auroc"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *[F.sum(c).alias(c) for c in also]
    ).withColumn("auroc", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("auroc")))


def average_precision(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """keys, ap: the step sum over distinct scores from the top; null without positives."""
    counts = running(score_counts(df, keys, y, p, weight), keys, {"pos": "tp", "neg": "fp"}, p, falling=True)
    return counts.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), F.sum("pos")).alias("ap")
    )


def macro(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean over the defined values and how many there are; NaN counts as undefined."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(F.avg(v).alias(f"macro_{value}"), F.count(v).alias("contributing"))


def f1_thresholds(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """keys, threshold, f1: of 0, each score and 1, the smallest threshold within 1e-12 of the best F1, flags being p >= t."""
    counts = score_counts(df, keys, y, p)
    ends = df.select(*keys).distinct().select(*keys, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias(p), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"))
    counts = counts.union(ends).groupBy(*keys, p).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("all_pos"))
    scan = running(counts, keys, {"pos": "tp", "neg": "fp"}, p, falling=True).join(totals, list(keys))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos")), F.lit(0.0))
    rated = scan.select(*keys, F.col(p).alias("t"), f1.alias("f1"))
    best = rated.groupBy(*keys).agg(F.max("f1").alias("best"))
    return rated.join(best, list(keys)).where("f1 >= best - 1e-12").groupBy(*keys).agg(F.min("t").alias("threshold"), F.max("best").alias("f1"))


def confusion(df: DataFrame, keys: Sequence[str], threshold: Column, y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    flag, pos, w = F.col(p) >= threshold, F.col(y) == 1, _w(weight)
    part = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    return df.groupBy(*keys).agg(
        part(flag & pos).alias("tp"), part(flag & ~pos).alias("fp"), part(~flag & ~pos).alias("tn"), part(~flag & pos).alias("fn")
    )


def operating_ratios(counts: DataFrame) -> DataFrame:
    """Eight ratios of a confusion table, null where undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return counts.withColumns(
        {
            "sensitivity": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp), "ppv": F.try_divide(tp, tp + fp),
            "npv": F.try_divide(tn, tn + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "prevalence": F.try_divide(tp + fn, n),
            "flag_rate": F.try_divide(tp + fp, n), "alarms_per_true": F.try_divide(tp + fp, tp),
        }
    )


def sensitivity_floor(df: DataFrame, keys: Sequence[str], floor: float, y: str = "y", p: str = "p") -> DataFrame:
    """keys, threshold, met: the largest score whose sensitivity reaches the floor; else 0 and false."""
    counts = score_counts(df, keys, y, p)
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("all_pos"))
    scan = running(counts, keys, {"pos": "tp"}, p, falling=True).join(totals, list(keys))
    top = scan.withColumn("share", F.try_divide("tp", "all_pos")).groupBy(*keys).agg(F.max(F.when(F.col("share") >= floor, F.col(p))).alias("t"))
    return top.select(*keys, F.coalesce("t", F.lit(0.0)).alias("threshold"), F.col("t").isNotNull().alias("met"))


def midranks(df: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    """Adds midrank in [0, 1]; equal scores share one."""
    counts = df.groupBy(*keys, p).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    scan = running(counts, keys, {"n": "upto"}, p).join(totals, list(keys))
    before = F.col("upto") - F.col("n")
    ranks = scan.select(*keys, p, ((before + (F.col("n") - 1) / F.lit(2.0)) / F.greatest(F.col("total") - 1, F.lit(1))).alias("midrank"))
    return df.join(ranks, [*keys, p])


def oriented(df: DataFrame, sign: Column, p: str = "p") -> DataFrame:
    """Rows with a defined score, times its sign."""
    return df.where(F.col(p).isNotNull() & ~F.isnan(p)).withColumn(p, F.col(p) * sign)


def at_points(curve: DataFrame, keys: Sequence[str], at: str, points: Sequence[float], digits: int = 6) -> DataFrame:
    """The curve's rows at the given points; every key has each of them once, or this fails."""
    from .expect import nothing

    asked = F.array(*[F.round(F.lit(float(x)), digits) for x in points])
    rows = curve.where(F.array_contains(asked, F.round(at, digits)))
    seen = curve.select(*keys).distinct().join(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(F.round(at, digits)).alias("d")), list(keys), "left")
    nothing(seen.where(f"coalesce(n, 0) <> {len(points)} or coalesce(d, 0) <> {len(points)}"), "points that the curve lacks")
    return rows
