"""Feature baselines: validate measured features, fit one penalised logistic model a label, score and compare shifts.

Rows are wide: keys, a column a feature (null or NaN where it could not be measured) and a 0/1 column y_<label> a label. All labels and
all penalties are fitted in the same passes: a task adds up gradients and Hessians of every (label, penalty) with two matrix
products a chunk, so a pass reads the rows once however many models there are, and only sums of the model's size leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import expit
from .bootstrap import interval, replicate_auroc
from .discrimination import auroc, macro, quantiles
from .fitting import standardize, standardizer
from .lineage import cut

#: The study's penalties, as inverse strengths, the strongest penalty first.
GRID = (0.01, 0.1, 1.0, 10.0)
#: Rows of a matrix product, and partitions that partial sums meet in.
CHUNK, MEET = 2048, 32


@dataclass(frozen=True)
class Check:
    """A feature that encodes a label's definition; sign 1 if larger values speak for it, else -1."""

    feature: str
    label: str
    sign: float


@dataclass(frozen=True)
class RateCheck:
    """A label that is defined by a feature being above or below a threshold."""

    feature: str
    label: str
    sign: float
    threshold: float
    side: str


def known(name: str) -> Column:
    """The value, null where it was not measured or is not finite."""
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def failure_rates(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """keys, feature, rate: the share of rows whose feature is unknown."""
    rates = df.groupBy(*keys).agg(*[F.avg(known(f).isNull().cast("double")).alias(f"rate_{i}") for i, f in enumerate(features)])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"rate_{i}").alias("rate")) for i, f in enumerate(features)])
    return rates.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")


def feature_validation(df: DataFrame, keys: Sequence[str], checks: Sequence[Check]) -> DataFrame:
    """keys, feature, label, sign, auroc of the feature alone, turned by its sign, over the rows that have it; null with one class only."""
    pairs = F.array(*[
        F.struct(F.lit(c.feature).alias("feature"), F.lit(c.label).alias("label"), F.lit(float(c.sign)).alias("sign"), (known(c.feature) * c.sign).alias("p"), F.col(f"y_{c.label}").alias("y"))
        for c in checks
    ])
    rows = df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*").where("p is not null and y is not null")
    by = [*keys, "feature", "label", "sign"]
    found = auroc(rows, by, any_range=True).select(*by, "auroc", F.expr("cast(pos + neg as long)").alias("used"))
    # A check without any usable row is told, not lost.
    asked = df.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.struct(F.lit(c.feature).alias("feature"), F.lit(c.label).alias("label"), F.lit(float(c.sign)).alias("sign")) for c in checks])).alias("x")).select(*keys, "x.*")
    return asked.join(found, by, "left").withColumn("used", F.coalesce("used", F.lit(0)))


def rate_checks(df: DataFrame, keys: Sequence[str], checks: Sequence[RateCheck], competing: Column) -> DataFrame:
    """keys, feature, label, positives, share of them on the defining side (unknown values are not), median over their known values,
    the feature's auroc without negatives for which competing holds, and the rows left for it."""
    side = lambda c, v: v < c.threshold if c.side == "below" else v > c.threshold
    out = F.array(*[
        F.struct(
            F.lit(c.feature).alias("feature"), F.lit(c.label).alias("label"), known(c.feature).alias("v"), (known(c.feature) * c.sign).alias("p"),
            F.col(f"y_{c.label}").alias("y"), F.coalesce(side(c, known(c.feature)), F.lit(False)).alias("defining"),
        )
        for c in checks
    ])
    by = [*keys, "feature", "label"]
    rows = df.select(*keys, F.coalesce(competing, F.lit(False)).alias("competing"), F.explode(out).alias("x")).select(*keys, "competing", "x.*")
    positive = F.col("y") == 1
    kept = positive | ~F.col("competing")
    counts = rows.groupBy(*by).agg(
        F.count_if(positive).alias("positives"), F.avg(F.when(positive, F.col("defining").cast("double"))).alias("defining_share"), F.count_if(kept).alias("rows_left")
    )
    medians = quantiles(rows.where(positive), by, "v", [0.5]).select(*by, F.col("q")[0].alias("median"))
    restricted = auroc(rows.where(kept & F.col("p").isNotNull()), by, any_range=True).select(*by, F.col("auroc").alias("restricted_auroc"))
    return counts.join(medians, by, "left").join(restricted, by, "left")


# --- fits


def triangle(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def newton_sums(rows: DataFrame, x: Sequence[str], y: Sequence[str], label_of: list[int], beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, gradient, Hessian) of every model, the intercept last, without penalties; rows with a null label add nothing to its models."""
    m, d = beta.shape
    upper = triangle(d)
    sizes = [m, m * d, m * len(upper[0])]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes))
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                data = np.column_stack([*[batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in x], np.ones(batch.num_rows)])
                target = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in y])[:, label_of]
                there = ~np.isnan(target)
                target = np.where(there, target, 0.0)
                z = data @ beta.T
                mu = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                loss = np.where(there, np.logaddexp(0, z) - target * z, 0.0).sum(axis=0)
                residual = np.where(there, mu - target, 0.0)
                weight = np.where(there, mu * (1 - mu), 0.0)
                total += np.concatenate([loss, (residual.T @ data).ravel(), (weight.T @ (data[:, upper[0]] * data[:, upper[1]])).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes))
        for batch in batches:
            total += batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    parts = rows.select(*x, *y).mapInArrow(task, "sums array<double>").repartition(MEET).mapInArrow(add, "sums array<double>")
    total = np.sum([r["sums"] for r in parts.collect()], axis=0)
    loss, gradient, half = np.split(total, np.cumsum(sizes)[:-1])
    hessian = np.zeros((m, d, d))
    hessian[:, upper[0], upper[1]] = half.reshape(m, -1)
    hessian[:, upper[1], upper[0]] = half.reshape(m, -1)
    return loss, gradient.reshape(m, d), hessian


def fit_labels(rows: DataFrame, x: Sequence[str], labels: Sequence[str], grid: Sequence[float] = GRID, most: int = 60, tolerance: float = 1e-9) -> dict[tuple[str, float], np.ndarray]:
    """Weights and intercept (last) of every (label, inverse penalty): the least summed loss plus |weights|^2 / (2 c), the intercept free.

    Newton steps for all models at once; a model whose penalised loss has risen goes half way back. A label of one class gets weights 0 and
    an intercept of +-20. Rows are held while fitting.
    """
    y = [f"y_{label}" for label in labels]
    models = [(label, float(c)) for label in labels for c in grid]
    label_of = [i for i in range(len(labels)) for _ in grid]
    ridge = np.array([1 / c for _, c in models])
    rows = rows.select(*x, *y).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        seen = rows.agg(*[F.min(c).alias(f"low_{c}") for c in y], *[F.max(c).alias(f"high_{c}") for c in y]).first()
        d = len(x) + 1
        beta = np.zeros((len(models), d))
        constant = {i: (20.0 if seen[f"low_y_{label}"] == 1 else -20.0) for i, (label, _) in enumerate(models) if seen[f"low_y_{label}"] == seen[f"high_y_{label}"]}
        for i, intercept in constant.items():
            beta[i, -1] = intercept
        open_ = np.array([i not in constant for i in range(len(models))])
        before, step, cost = beta.copy(), np.zeros_like(beta), np.full(len(models), np.inf)
        for _ in range(most):
            if not open_.any():
                return dict(zip(models, beta))
            loss, gradient, hessian = newton_sums(rows, x, y, label_of, beta)
            now = loss + ridge / 2 * (beta[:, :-1] ** 2).sum(axis=1)
            gradient[:, :-1] += ridge[:, None] * beta[:, :-1]
            hessian[:, range(d - 1), range(d - 1)] += ridge[:, None]
            for i in np.flatnonzero(open_):
                if now[i] > cost[i] * (1 + 1e-12) + 1e-12:
                    step[i] /= 2
                else:
                    before[i], cost[i] = beta[i], now[i]
                    step[i] = -np.linalg.lstsq(hessian[i], gradient[i], rcond=None)[0]
                beta[i] = before[i] + step[i]
                open_[i] = np.abs(step[i]).max() > tolerance
        raise RuntimeError("fits did not settle")
    finally:
        rows.unpersist()


def linear_score(x: Sequence[str], beta: Sequence[float]) -> Column:
    """The model's probability as a column expression."""
    z = F.lit(float(beta[-1]))
    for name, b in zip(x, beta):
        z = z + F.col(name) * F.lit(float(b))
    return expit(z)


def long_scores(df: DataFrame, x: Sequence[str], models: dict[tuple, Sequence[float]], carry: Sequence[str]) -> DataFrame:
    """carry, label, c, y, p: a row for each model, all by expressions over one scan."""
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(float(c)).alias("c"), F.col(f"y_{label}").alias("y"), linear_score(x, b).alias("p")) for (label, c), b in models.items()])
    return df.select(*carry, F.explode(each).alias("m")).select(*carry, "m.*")


def choose(df: DataFrame, x: Sequence[str], models: dict[tuple[str, float], np.ndarray], grid: Sequence[float] = GRID) -> dict[tuple[str, float], np.ndarray]:
    """Of each label the model with the best auroc on df; undefined counts as 0, and of equals the first of the grid stays."""
    found = {(r["label"], r["c"]): r["auroc"] or 0.0 for r in auroc(long_scores(df, x, models, []), ["label", "c"]).collect()}
    out = {}
    for label in dict.fromkeys(name for name, _ in models):
        best = max(grid, key=lambda c: (found.get((label, float(c)), 0.0), -list(grid).index(c)))
        out[label, float(best)] = models[label, float(best)]
    return out


def design(df: DataFrame, fit_rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """df with standardised features and 0/1 columns of unknown ones; moments come from fit_rows. And the columns' names."""
    clean = lambda d: d.withColumns({f: known(f) for f in features})
    rows = standardize(clean(df), standardizer(clean(fit_rows), features), features)
    return rows, [f"{f}_z" for f in features] + [f"{f}_missing" for f in features]


# --- performance, shift and comparison


def performance(scores: DataFrame, internal: str, headline: Sequence[str], replicates: int) -> dict[str, DataFrame]:
    """Tables by name: label (cohort, label, value, bounds), macro (cohort, ...), shift (external cohort, label, ...) and macro_shift.

    scores: cohort, cluster_id, label, y, p. Cohorts share a replicate's weights, so shifts are paired by it. Macro means are over the
    headline labels that are defined.
    """
    keys = ["cohort", "label"]
    # Every table reads both, which are as small as labels by replicates: made once, and the plan ends there.
    points = cut(auroc(scores, keys).select(*keys, F.col("auroc").alias("value")))
    reps = cut(replicate_auroc(scores, keys, replicates).withColumnRenamed("auroc", "value"))
    of_headline = F.col("label").isin(list(headline))
    macro_of = lambda t, by: macro(t.where(of_headline), by, "value").select(*by, F.col("macro_value").alias("value"))
    macro_points, macro_reps = macro_of(points, ["cohort"]), macro_of(reps, ["cohort", "replicate"])

    def change(t: DataFrame, on: list[str]) -> DataFrame:
        inside = t.where(F.col("cohort") == internal).select(*on, F.col("value").alias("inside"))
        outside = t.where(F.col("cohort") != internal)
        both = outside.join(inside, on) if on else outside.join(F.broadcast(inside), F.lit(True))
        return both.withColumn("value", F.col("value") - F.col("inside")).drop("inside")

    def bounded(p: DataFrame, r: DataFrame, by: list[str]) -> DataFrame:
        return p.join(interval(r, by, "value").select(*by, "lower", "upper"), by, "left")

    return {
        "label": bounded(points, reps, keys), "macro": bounded(macro_points, macro_reps, ["cohort"]),
        "shift": bounded(change(points, ["label"]), change(reps, ["label", "replicate"]), keys),
        "macro_shift": bounded(change(macro_points, []), change(macro_reps, ["replicate"]), ["cohort"]),
    }


def compare_shifts(own: DataFrame, committed: DataFrame, headline: Sequence[str], classes: dict[str, str]) -> dict[str, DataFrame]:
    """Tables by name: pairs (cohort, label, own, committed), correlation (cohort, labels, rho, p) and class_means (cohort, finding_class, labels, own, committed).

    own and committed: cohort, label, value. Every headline label must be committed; labels outside the classes have no class.
    """
    from .expect import nothing
    from .shift import correlations

    own = own.where(F.col("label").isin(list(headline))).select("cohort", "label", F.col("value").alias("own"))
    theirs = committed.select("cohort", "label", F.col("value").alias("committed"))
    nothing(own.join(theirs, ["cohort", "label"], "left_anti"), "shifts that were never committed")
    pairs = own.join(theirs, ["cohort", "label"])
    kind = F.element_at(F.create_map(*[F.lit(v) for pair in classes.items() for v in pair]), F.col("label"))
    means = pairs.withColumn("finding_class", kind).where("finding_class is not null").groupBy("cohort", "finding_class").agg(
        F.count("*").alias("labels"), F.avg("own").alias("own"), F.avg("committed").alias("committed")
    )
    rank = correlations(pairs, ["cohort"], "own", "committed").select("cohort", F.col("n").alias("labels"), F.col("spearman").alias("rho"), F.col("spearman_p").alias("p"))
    return {"pairs": pairs, "correlation": rank, "class_means": means}
