"""Feature baseline queries: validation of features, per-label fits, performance, shift and comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baseline as BL
from ..operators import beats
from ..operators.lineage import cut
from ..sources import adapters
from .composites import auc_sql
from .records import beat_signals
from .registry import query, rounded
from .studies import REPLICATES, WEIGHTS, boot_sql

#: A row an order: measured features, one of them unknown for some, and labels that some of them define.
FEATURES = """
SELECT o_orderstatus AS cohort, o_orderkey AS record_id, o_custkey AS cluster_id, CAST(o_orderkey % 10 + 1 AS INT) AS fold,
       ROUND(AVG(l_quantity), 6) AS quantity, CAST(COUNT(*) AS DOUBLE) AS lines, MAX(l_discount) AS discount,
       ROUND(AVG(CASE WHEN l_linestatus = 'F' THEN l_tax END), 6) AS filled_tax, MAX(o_totalprice) AS price,
       MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y_returned, MAX(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS y_large,
       MAX(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS y_urgent, MAX(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS y_taxed
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderstatus, o_orderkey, o_custkey
"""
LABELS = ("returned", "large", "urgent", "taxed")
COLUMNS = ("quantity", "lines", "discount", "filled_tax")
CLASSES = {"large": "measured", "taxed": "measured", "returned": "reading"}
CHECKS = [BL.Check("quantity", "large", 1), BL.Check("lines", "returned", 1), BL.Check("lines", "large", 1), BL.Check("filled_tax", "taxed", 1), BL.Check("discount", "urgent", -1)]
RATES = [BL.RateCheck("quantity", "large", 1, 30.0, "above"), BL.RateCheck("filled_tax", "taxed", 1, 0.04, "above"), BL.RateCheck("lines", "returned", -1, 3.0, "below")]
FT = f"ft AS ({adapters.fill(FEATURES)})"


def features(spark, sf_dir) -> DataFrame:
    return adapters.run(spark, sf_dir, FEATURES)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def melted(df: DataFrame, section: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """section, keys, metric, value: a row a metric."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(section).alias("section"), *keys, F.explode(pairs).alias("m")).select("section", *keys, "m.*")


def validation(df: DataFrame, columns, checks, rates, competing) -> DataFrame:
    """section, cohort, label, feature, metric, value of the three parts of a feature validation."""
    failed = melted(BL.failure_rates(df, ["cohort"], columns), "detection_failure", ["cohort", "feature"], ["rate"])
    single = melted(BL.feature_validation(df, ["cohort"], checks), "feature_validation", ["cohort", "feature", "label"], ["sign", "auroc", "used"])
    rate = melted(BL.rate_checks(df, ["cohort"], rates, competing), "rate_check", ["cohort", "feature", "label"], ["positives", "defining_share", "median", "restricted_auroc", "rows_left"])
    return union([failed, single, rate]).select("section", "cohort", "label", "feature", "metric", "value")


def validation_sql() -> str:
    failed = " UNION ALL ".join(f"SELECT 'detection_failure' AS section, cohort, CAST(NULL AS VARCHAR) AS label, '{f}' AS feature, 'rate' AS metric, AVG(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END) AS value FROM ft GROUP BY cohort" for f in COLUMNS)
    single = " UNION ALL ".join(f"SELECT cohort, '{c.feature}' AS feature, '{c.label}' AS label, CAST({c.sign} AS DOUBLE) AS sign, {c.feature} * {c.sign} AS p, y_{c.label} AS y FROM ft WHERE {c.feature} IS NOT NULL" for c in CHECKS)
    rate = " UNION ALL ".join(f"SELECT cohort, '{c.feature}' AS feature, '{c.label}' AS label, {c.feature} AS v, {c.feature} * {c.sign} AS p, y_{c.label} AS y, CASE WHEN coalesce({c.feature} {'<' if c.side == 'below' else '>'} CAST({c.threshold} AS DOUBLE), false) THEN 1 ELSE 0 END AS defining, y_urgent = 1 AS competing FROM ft" for c in RATES)
    pick = lambda section, metric, value, source: f"SELECT '{section}' AS section, cohort, label, feature, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value FROM {source}"
    parts = [pick("feature_validation", m, v, "sa") for m, v in (("sign", "sign"), ("auroc", "auroc"), ("used", "pos + neg"))]
    parts += [pick("rate_check", m, m, "rc") for m in ("positives", "defining_share", "median", "rows_left")] + [pick("rate_check", "restricted_auroc", "auroc", "ra")]
    return f"""WITH {FT}, {auc_sql(single, "cohort, feature, label, sign", "sa")}, rr AS ({rate}), {auc_sql("SELECT * FROM rr WHERE p IS NOT NULL AND (y = 1 OR NOT competing)", "cohort, feature, label", "ra")},
 rc AS (SELECT cohort, feature, label, SUM(y) AS positives, AVG(defining) FILTER (WHERE y = 1) AS defining_share, median(v) FILTER (WHERE y = 1) AS median, COUNT(*) FILTER (WHERE y = 1 OR NOT competing) AS rows_left FROM rr GROUP BY ALL)
SELECT section, cohort, label, feature, metric, round(value, 6) + 0 AS value FROM ({failed} UNION ALL {" UNION ALL ".join(parts)})"""


@query("q26_feature_validation", validation_sql())
def q26(spark, sf_dir):
    """Unknown shares, each feature alone against the label it defines, and the defining side of positives without competing negatives."""
    return rounded(validation(features(spark, sf_dir), COLUMNS, CHECKS, RATES, F.col("y_urgent") == 1))


@query("q26_signal_validation")
def q26_signal(spark, sf_dir):
    """The same on beat features of stand-in signals, an embedding's label standing for the finding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = ["heart_rate_bpm", "qrs_duration_ms", "pr_interval_ms", "qt_interval_ms"]
    # Measuring a record costs far more than reading its features again, which every section does: written once, a few numbers a record.
    found = cut(beats.feature_table(beat_signals(spark, sf_dir), "vec_id").select("vec_id", *names))
    rows = found.join(e.select("vec_id", "label"), "vec_id")
    rows = rows.withColumns({"cohort": F.lit("signals"), "y_even": F.coalesce((F.col("label") % 2 == 0).cast("int"), F.lit(0)), "y_low": F.coalesce((F.col("label") < 3).cast("int"), F.lit(0))})
    checks = [BL.Check(n, y, s) for n in names for y, s in (("even", 1), ("low", -1))]
    return rounded(validation(rows, names, checks, [BL.RateCheck("heart_rate_bpm", "even", 1, 100.0, "above"), BL.RateCheck("heart_rate_bpm", "low", -1, 60.0, "below")], F.col("label") == 5))


#: Committed weights: centre and scale of each column, and for each label the columns' weights, the weight of an unknown tax and the intercept.
MOMENTS = {"quantity": (25.5, 9.0), "lines": (4.0, 2.0), "filled_tax": (0.04, 0.02)}
WEIGHTS_OF = {
    "returned": ((0.1, 0.9, -0.05), 0.3, 0.2), "large": ((1.2, 0.7, 0.0), -0.1, -0.4), "urgent": ((-0.03, 0.02, 0.04), 0.05, -1.4), "taxed": ((0.02, 0.8, 0.6), -0.2, 0.1),
}


def frozen_scores(df: DataFrame) -> DataFrame:
    z = {f"{c}_z": F.coalesce((F.col(c) - m) / s, F.lit(0.0)) for c, (m, s) in MOMENTS.items()}
    rows = df.withColumns(z | {"filled_tax_missing": F.col("filled_tax").isNull().cast("int")})
    models = {(label, 1.0): [*own, missing, intercept] for label, (own, missing, intercept) in WEIGHTS_OF.items()}
    return BL.long_scores(rows, [*z, "filled_tax_missing"], models, ["cohort", "cluster_id"])


def plain_scores(df: DataFrame) -> DataFrame:
    """The model that was committed before: the quantity alone, for every label."""
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"y_{label}").alias("y")) for label in LABELS])
    return df.select("cohort", "cluster_id", (F.col("quantity") / 50).alias("p"), F.explode(each).alias("m")).select("cohort", "cluster_id", "p", "m.*")


def report(scores: DataFrame, committed: DataFrame, replicates: int) -> DataFrame:
    """section, cohort, label, finding_class, metric, value, lower, upper: performance, shift, comparison."""
    nine = lambda d: d.withColumn("p", F.round("p", 9))
    tables = BL.performance(nine(scores), "F", LABELS, replicates)
    before = BL.performance(nine(committed), "F", LABELS, replicates)["shift"]
    against = BL.compare_shifts(tables["shift"], before, LABELS, CLASSES)
    parts = [t.withColumns({"section": F.lit(name), "metric": F.lit("auroc" if "shift" not in name else "shift_delta")}) for name, t in tables.items()]
    parts += [melted(against["pairs"], "comparison", ["cohort", "label"], ["own", "committed"]), melted(against["correlation"], "rank_correlation", ["cohort"], ["labels", "rho", "p"])]
    parts += [melted(against["class_means"], "class_means", ["cohort", "finding_class"], ["labels", "own", "committed"])]
    return union(parts).select("section", "cohort", "label", "finding_class", "metric", "value", "lower", "upper")


def report_sql() -> str:
    z = lambda own, missing, b: f"{b}" + "".join(f" + coalesce(({c} - {m}) / {s}, 0) * {w}" for (c, (m, s)), w in zip(MOMENTS.items(), own)) + f" + CASE WHEN filled_tax IS NULL THEN 1 ELSE 0 END * {missing}"
    double = lambda text: f"CAST({text} AS DOUBLE)"
    rows = [f"SELECT cohort, cluster_id, 'own' AS model, '{y}' AS label, y_{y} AS y, round(1 / (1 + exp(-({double(z(*WEIGHTS_OF[y]))}))), 9) AS p FROM ft" for y in LABELS]
    rows += [f"SELECT cohort, cluster_id, 'committed', '{y}', y_{y}, round(quantity / 50, 9) FROM ft" for y in LABELS]
    bounds = "quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper"
    none = "CAST(NULL AS VARCHAR)"
    line = lambda section, metric, source, label=none, kind=none, value="value", lower="CAST(NULL AS DOUBLE)", upper="CAST(NULL AS DOUBLE)": f"SELECT '{section}' AS section, cohort, {label} AS label, {kind} AS finding_class, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value, {lower} AS lower, {upper} AS upper FROM {source}"
    bounded = dict(lower="lower", upper="upper")
    out = [
        line("label", "auroc", "lp", "label", **bounded), line("macro", "auroc", "mp", **bounded), line("shift", "shift_delta", "sp", "label", **bounded), line("macro_shift", "shift_delta", "xp", **bounded),
        *[line("comparison", m, "pr", "label", value=m) for m in ("own", "committed")], *[line("rank_correlation", m, "rk", value=m) for m in ("labels", "rho", "p")],
        *[line("class_means", m, "cm", kind="finding_class", value=m) for m in ("labels", "own", "committed")],
    ]
    return f"""WITH {FT}, sc AS ({" UNION ALL ".join(rows)}), {auc_sql("SELECT * FROM sc", "cohort, model, label", "a")}, {WEIGHTS}, {boot_sql("SELECT * FROM sc", "cohort, model, label")},
 pt AS (SELECT cohort, model, label, auroc AS value FROM a), rp AS (SELECT cohort, model, label, replicate, auroc AS value FROM boot),
 mpt AS (SELECT cohort, model, AVG(value) AS value FROM pt GROUP BY ALL), mrp AS (SELECT cohort, model, replicate, AVG(value) AS value FROM rp GROUP BY ALL),
 spt AS (SELECT x.cohort, model, label, x.value - i.value AS value FROM pt x JOIN pt i USING (model, label) WHERE i.cohort = 'F' AND x.cohort <> 'F'), srp AS (SELECT x.cohort, model, label, x.value - i.value AS value FROM rp x JOIN rp i USING (model, label, replicate) WHERE i.cohort = 'F' AND x.cohort <> 'F'),
 xpt AS (SELECT x.cohort, x.value - i.value AS value FROM mpt x JOIN mpt i USING (model) WHERE model = 'own' AND i.cohort = 'F' AND x.cohort <> 'F'), xrp AS (SELECT x.cohort, x.value - i.value AS value FROM mrp x JOIN mrp i USING (model, replicate) WHERE model = 'own' AND i.cohort = 'F' AND x.cohort <> 'F'),
 lp AS (SELECT pt.cohort, pt.label, pt.value, lower, upper FROM pt JOIN (SELECT cohort, model, label, {bounds} FROM rp GROUP BY ALL) b USING (cohort, model, label) WHERE pt.model = 'own'),
 mp AS (SELECT mpt.cohort, mpt.value, lower, upper FROM mpt JOIN (SELECT cohort, model, {bounds} FROM mrp GROUP BY ALL) b USING (cohort, model) WHERE mpt.model = 'own'),
 sp AS (SELECT spt.cohort, spt.label, spt.value, lower, upper FROM spt JOIN (SELECT cohort, model, label, {bounds} FROM srp GROUP BY ALL) b USING (cohort, model, label) WHERE spt.model = 'own'),
 xp AS (SELECT xpt.cohort, xpt.value, lower, upper FROM xpt JOIN (SELECT cohort, {bounds} FROM xrp GROUP BY ALL) b USING (cohort)),
 pr AS (SELECT x.cohort, x.label, x.value AS own, c.value AS committed FROM spt x JOIN spt c USING (cohort, label) WHERE x.model = 'own' AND c.model = 'committed'),
 rk0 AS (SELECT cohort, own, committed, rank() OVER (PARTITION BY cohort ORDER BY own) + (COUNT(*) OVER (PARTITION BY cohort, own) - 1) / CAST(2 AS DOUBLE) AS rx, rank() OVER (PARTITION BY cohort ORDER BY committed) + (COUNT(*) OVER (PARTITION BY cohort, committed) - 1) / CAST(2 AS DOUBLE) AS ry FROM pr),
 rk AS (SELECT cohort, COUNT(*) AS labels, corr(rx, ry) AS rho, 1 - ABS(corr(rx, ry)) AS p FROM rk0 GROUP BY cohort),
 cm AS (SELECT cohort, CASE label {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items())} END AS finding_class, COUNT(*) AS labels, AVG(own) AS own, AVG(committed) AS committed FROM pr WHERE label <> 'urgent' GROUP BY ALL)
SELECT section, cohort, label, finding_class, metric, round(value, 6) + 0 AS value, round(lower, 6) + 0 AS lower, round(upper, 6) + 0 AS upper FROM ({" UNION ALL ".join(out)})"""


@query("q27_frozen_baseline", report_sql())
def q27_frozen(spark, sf_dir):
    """Performance, shift and comparison of a baseline with committed weights. Four labels, so a correlation's p is 1 - |rho|."""
    # Points and replicates of both models read the features: written once.
    df = cut(features(spark, sf_dir))
    return rounded(report(frozen_scores(df), plain_scores(df), REPLICATES))


def fitted(spark, sf_dir):
    """(design, its columns, chosen models) of all labels over the whole grid: fitted on folds 1 to 8, chosen on fold 9."""
    # Moments, fits, choice and every table after them read the features: written once.
    df = cut(features(spark, sf_dir))
    inside = F.col("cohort") == "F"
    rows, x = BL.design(df, df.where(inside & (F.col("fold") <= 8)), COLUMNS)
    models = BL.fit_labels(rows.where(inside & (F.col("fold") <= 8)), x, LABELS)
    return rows, x, BL.choose(rows.where(inside & (F.col("fold") == 9)), x, models)


@query("e08_label_fits")
def e08_label_fits(spark, sf_dir):
    """Chosen penalty and weights of every label."""
    _, x, models = fitted(spark, sf_dir)
    rows = [(label, float(c), name, float(b)) for (label, c), beta in models.items() for name, b in zip([*x, "intercept"], beta)]
    return spark.createDataFrame(rows, "label string, c double, term string, weight double")


@query("q27_feature_baseline")
def q27(spark, sf_dir):
    """The whole baseline: fit, choice by label, scores of the held-out fold and of other cohorts, performance, shift, comparison."""
    rows, x, models = fitted(spark, sf_dir)
    tested = rows.where((F.col("cohort") != "F") | (F.col("fold") == 10))
    return rounded(report(BL.long_scores(tested, x, models, ["cohort", "cluster_id"]), plain_scores(tested), REPLICATES))
