"""Fits: temperature, logit slope and offset, target prevalence, calibration ladder, regularised logistic models.

Spark first sums rows to distinct (key, score) counts; the iteration then runs on those numbers, a key in a task. Where a key has more
distinct scores than a task should hold, digits rounds them; by default scores are taken as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import affine, bbse_prevalence, prior_shift_offset
from .discrimination import f1_thresholds
from .lineage import cut

CLIP = 1e-7


def counts(df: DataFrame, keys: Sequence[str], digits: int | None = None) -> DataFrame:
    """keys, p, pos, neg; with digits, p is rounded and a key has at most 10**digits + 1 rows."""
    return df.groupBy(*keys, (F.col("p") if digits is None else F.round("p", digits)).alias("p")).agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))


def _logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, CLIP, 1 - CLIP)
    return np.log(q / (1 - q))


def _nll(z: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    soft = np.logaddexp(0, z)
    return float((pos * (soft - z) + neg * soft).sum())


def fit_temperature(p: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    """The T in [e**-5, e**5] with the least likelihood loss of expit(logit(p) / T), by golden section over log T."""
    z = _logit(p)
    loss = lambda s: _nll(z * np.exp(-s), pos, neg)
    low, high, g = -5.0, 5.0, (np.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = loss(a), loss(b)
    while high - low > 1e-9:
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = loss(b)
    return float(np.exp((low + high) / 2))


def fit_affine(p: np.ndarray, pos: np.ndarray, neg: np.ndarray, offset_only: bool = False) -> tuple[float, float, bool]:
    """(slope, offset, fitted) by damped Newton steps; one class only gives the identity."""
    if pos.sum() == 0 or neg.sum() == 0:
        return 1.0, 0.0, False
    x, n = _logit(p), pos + neg
    theta = np.array([1.0, 0.0])
    for _ in range(200):
        z = theta[0] * x + theta[1]
        mu = 1 / (1 + np.exp(-z))
        r, h = n * mu - pos, n * mu * (1 - mu)
        grad = np.array([(r * x).sum(), r.sum()])
        hess = np.array([[(h * x * x).sum(), (h * x).sum()], [(h * x).sum(), h.sum()]]) + 1e-9 * np.eye(2)
        step = np.array([0.0, grad[1] / hess[1, 1]]) if offset_only else np.linalg.solve(hess, grad)
        size, now = 1.0, _nll(z, pos, neg)
        while size > 1e-6:
            new = theta - size * step
            new = np.array([np.clip(new[0], 0.01, 10.0), np.clip(new[1], -10.0, 10.0)])
            if _nll(new[0] * x + new[1], pos, neg) <= now:
                break
            size /= 2
        if np.abs(new - theta).max() < 1e-10:
            break
        theta = new
    return float(theta[0]), float(theta[1]), True


def em_prevalence(p: np.ndarray, n: np.ndarray, source: float, most: int = 1000, tolerance: float = 1e-10) -> tuple[float, int]:
    """Target prevalence by expectation-maximization from scores calibrated at the source prevalence."""
    if not 0 < source < 1:
        return float("nan"), 0
    now = source
    for step in range(1, most + 1):
        a, b = p * now / source, (1 - p) * (1 - now) / (1 - source)
        new = float((n * a / np.maximum(a + b, 1e-300)).sum() / n.sum())
        if abs(new - now) < tolerance:
            return new, step
        now = new
    return now, most


def _by_key(df: DataFrame, keys: Sequence[str], out: str, f) -> DataFrame:
    schema = StructType([df.schema[k] for k in keys] + StructType.fromDDL(out).fields)

    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *f(rows))], columns=schema.names)

    return df.groupBy(*keys).applyInPandas(kernel, schema)


def temperatures(df: DataFrame, keys: Sequence[str], digits: int | None = None) -> DataFrame:
    return _by_key(counts(df, keys, digits), keys, "temperature double", lambda r: (fit_temperature(r["p"].to_numpy(), r["pos"].to_numpy(), r["neg"].to_numpy()),))


def affine_fits(df: DataFrame, keys: Sequence[str], offset_only: bool = False, digits: int | None = None) -> DataFrame:
    return _by_key(
        counts(df, keys, digits), keys, "slope double, offset double, fitted boolean",
        lambda r: fit_affine(r["p"].to_numpy(), r["pos"].to_numpy(), r["neg"].to_numpy(), offset_only),
    )


def prevalences(df: DataFrame, source: DataFrame, keys: Sequence[str], label_keys: Sequence[str]) -> DataFrame:
    """keys, prevalence, steps; source: label_keys, source_prevalence."""
    rows = counts(df, keys).join(source, list(label_keys))
    out = _by_key(rows, keys, "prevalence double, steps int", lambda r: em_prevalence(r["p"].to_numpy(), (r["pos"] + r["neg"]).to_numpy(), r["source_prevalence"].iloc[0]))
    return out.withColumn("prevalence", F.nanvl("prevalence", F.lit(None).cast("double")))


RUNGS = ("none", "temperature", "estimated_prior", "flagged_prior", "known_prior", "oracle_temperature", "oracle_label_temperature", "fitted_offset", "fitted_affine")


def calibration_ladder(df: DataFrame, model_keys: Sequence[str], internal: str) -> DataFrame:
    """Long predictions of each rung of ladder_rungs(): a row becomes one row a rung."""
    keys = ["cohort", *model_keys, "label"]
    return df.join(ladder_rungs(df, model_keys, internal), keys).withColumn("p", affine(F.col("p"), F.col("slope"), F.col("offset"))).drop("slope", "offset")


def ladder_rungs(df: DataFrame, model_keys: Sequence[str], internal: str) -> DataFrame:
    """cohort, model keys, label, rung, slope, offset of RUNGS: none, one temperature, offsets by known or estimated prevalence, fitted offsets and affine maps.

    df: cohort, fold, model keys, label, y, p. Fold 9 of the internal cohort fits the rungs that may not see the target, folds up to 8
    give the source prevalence; the oracle and fitted rungs are fitted on the target itself, as ceilings. A rung is a table of slope and
    offset joined to the rows; where a prevalence can't be told it leaves the scores as they are.
    """
    label_keys = [*model_keys, "label"]
    keys = ["cohort", *label_keys]
    held = df.where((F.col("cohort") == internal) & (F.col("fold") == 9))
    train = df.where((F.col("cohort") == internal) & (F.col("fold") <= 8))
    source = train.groupBy(*label_keys).agg(F.avg("y").alias("source_prevalence"))
    target = df.groupBy(*keys).agg(F.avg("y").alias("target_prevalence"))
    one = temperatures(held, model_keys).select(*model_keys, (1 / F.col("temperature")).alias("slope"), F.lit(0.0).alias("offset"))
    estimated = prevalences(df, source, keys, label_keys)
    hotter = lambda own: temperatures(df, own).select(*own, (1 / F.col("temperature")).alias("slope"), F.lit(0.0).alias("offset"))
    cuts = f1_thresholds(held, label_keys).select(*label_keys, "threshold")
    flag = (F.col("p") >= F.col("threshold")).cast("double")
    rate = lambda v: F.avg(F.when(F.col("y") == v, flag))
    rates = held.join(cuts, label_keys).groupBy(*label_keys).agg(rate(1).alias("tpr"), rate(0).alias("fpr"))
    flagged = df.join(cuts, label_keys).groupBy(*keys).agg(F.avg(flag).alias("flagged")).join(rates, label_keys)
    flagged = flagged.select(*keys, bbse_prevalence(F.col("flagged"), F.col("tpr"), F.col("fpr")).alias("told"))

    def shift(t: DataFrame, name: str) -> DataFrame:
        offset = F.coalesce(prior_shift_offset(F.col("source_prevalence"), F.col(name)), F.lit(0.0))
        offset = F.when(F.col(name).isNotNull(), offset).otherwise(0.0)
        return t.join(source, label_keys).select(*keys, F.lit(1.0).alias("slope"), offset.alias("offset"))

    base = target.select(*keys)
    rungs = {
        "none": base.select(*keys, F.lit(1.0).alias("slope"), F.lit(0.0).alias("offset")),
        "temperature": base.join(one, list(model_keys)).select(*keys, "slope", "offset"),
        "estimated_prior": shift(estimated, "prevalence"),
        "flagged_prior": shift(flagged, "told"),
        "known_prior": shift(target, "target_prevalence"),
        "oracle_temperature": base.join(hotter(["cohort", *model_keys]), ["cohort", *model_keys]).select(*keys, "slope", "offset"),
        "oracle_label_temperature": base.join(hotter(keys), keys).select(*keys, "slope", "offset"),
        "fitted_offset": affine_fits(df, keys, offset_only=True).select(*keys, "slope", "offset"),
        "fitted_affine": affine_fits(df, keys).select(*keys, "slope", "offset"),
    }
    table = None
    for name, rung in rungs.items():
        rung = rung.withColumn("rung", F.lit(name))
        table = rung if table is None else table.unionByName(rung)
    return table


def first_drawn(rows: DataFrame, totals: DataFrame, keys: Sequence[str], ties: Sequence[str], most: int, repeats: int) -> DataFrame:
    """rows with place (from 1) of the first most rows of each key and repeat by drawn, an even 64-bit hash, and ties; totals: keys, n_all, a row a key."""
    wanted = 2 * most + 100
    reach = F.when(F.col("n_all") > wanted, (F.lit(-(2.0**63)) + F.lit(2.0**64) * (wanted / F.col("n_all"))).cast("long")).otherwise(F.lit(2**63 - 1))
    # As many rows as keys; then by repeats.
    bounds = cut(totals.withColumn("reach", reach))
    near = cut(rows.join(F.broadcast(bounds.select(*keys, "reach")), list(keys)).where("drawn <= reach"))
    every = bounds.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    seen = near.groupBy(*keys, "repeat").agg(F.count("*").alias("met"))
    short = every.join(seen, [*keys, "repeat"], "left").where(F.coalesce("met", F.lit(0)) < F.least(F.lit(most), F.col("n_all"))).select(*keys, "repeat", "reach")
    if not short.isEmpty():
        near = near.unionByName(rows.join(F.broadcast(short), [*keys, "repeat"]).where("drawn > reach"))
    order = W.partitionBy(*keys, "repeat").orderBy("drawn", *ties)
    return near.drop("reach").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("drawn")


def platt_recovery(df: DataFrame, keys: Sequence[str], record: str, sizes: list[int], repeats: int, seed: int, bins: int = 15) -> DataFrame:
    """keys, k, held_out_ece, sd: error on the rest after an affine fit on k labelled records, over repeats draws.

    A draw is the first k records by a hash of record and repeat, so larger k add to smaller ones. Hashes below a bound that about twice as many
    rows meet are ranked alone, and all of a key's and repeat's where too few meet it. Only drawn rows are fitted, k a task; the error comes from the bins of a key's distinct scores less those of the drawn rows. Null where none is held out.
    """
    rows = df.select(*keys, record, "y", "p").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = rows.withColumn("drawn", F.xxhash64(F.lit(seed), F.col("repeat"), F.col(record)))
    first = first_drawn(rows, df.groupBy(*keys).agg(F.count("*").alias("n_all")), keys, [record, "p", "y"], max(sizes), repeats)
    drawn = first.withColumn("k", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(F.col("place") <= F.col("k"))
    draw = [*keys, "k", "repeat"]
    fits = _by_key(drawn, draw, "slope double, offset double, fitted boolean", lambda r: fit_affine(r["p"].to_numpy(), r["y"].to_numpy(float), 1.0 - r["y"].to_numpy(float)))
    every = counts(df, keys).select(*keys, "p", "pos", (F.col("pos") + F.col("neg")).alias("n")).join(fits, list(keys))
    less = drawn.select(*draw, "p", (-F.col("y").cast("double")).alias("pos"), F.lit(-1.0).alias("n")).join(fits, draw)
    columns = [*draw, "p", "pos", "n", "slope", "offset"]
    both = every.select(*columns).unionByName(less.select(*columns)).withColumn("p", affine(F.col("p"), F.col("slope"), F.col("offset")))
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")
    gaps = both.groupBy(*draw, place).agg(F.sum(F.col("n") * F.col("p") - F.col("pos")).alias("gap"), F.sum("n").alias("n"))
    errors = gaps.groupBy(*draw).agg(F.sum(F.abs("gap")).alias("gap"), F.sum("n").alias("n"))
    ece = F.when(F.col("n") > 0, F.col("gap") / F.col("n"))
    return errors.groupBy(*keys, "k").agg(F.avg(ece).alias("held_out_ece"), F.stddev_samp(ece).alias("sd"))


def standardizer(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: centre and scale of each column over its known values; a scale of 1e-12 or less counts as 1."""
    v = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    return df.agg(
        *[F.coalesce(F.avg(v(c)), F.lit(0.0)).alias(f"{c}_centre") for c in columns],
        *[F.when(F.stddev_pop(v(c)) > 1e-12, F.stddev_pop(v(c))).otherwise(1.0).alias(f"{c}_scale") for c in columns],
    )


def standardize(df: DataFrame, moments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns centred and scaled, unknown values at the centre, and one 0/1 column each for having been unknown."""
    values = moments.first().asDict()
    v = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    return df.withColumns(
        {f"{c}_z": F.coalesce((v(c) - values[f"{c}_centre"]) / values[f"{c}_scale"], F.lit(0.0)) for c in columns}
        | {f"{c}_missing": v(c).isNull().cast("int") for c in columns}
    )


def logistic(train: DataFrame, features: Sequence[str], label: str, c: float):
    """L2-penalised logistic model; c is the inverse penalty on the summed loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(train)
    fit = LogisticRegression(featuresCol="features", labelCol=label, elasticNetParam=0.0, regParam=1.0 / (c * train.count()), standardization=False, maxIter=200, tol=1e-9)
    return fit.fit(rows)


def logistic_grid(train: DataFrame, check: DataFrame, features: Sequence[str], label: str, grid: Sequence[float]):
    """(c, auroc, model) of the best on check; the first of equals."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from .discrimination import auroc

    best = None
    for c in grid:
        model = logistic(train, features, label, c)
        scored = model.transform(VectorAssembler(inputCols=list(features), outputCol="features").transform(check))
        scored = scored.select(F.col(label).cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))
        value = auroc(scored, []).first()["auroc"]
        if value is not None and (best is None or value > best[1]):
            best = (c, value, model)
    return best


def best_checkpoint(df: DataFrame, run: Sequence[str]) -> DataFrame:
    """Of each run the epoch with the highest auroc, then the lowest nll, then the first."""
    order = W.partitionBy(*run).orderBy(F.desc("auroc"), "nll", "epoch")
    return df.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
