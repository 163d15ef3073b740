"""Queries on discrimination, calibration, thresholds and operating points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import calibration as C
from ..operators import discrimination as D
from ..sources.adapters import predictions
from .registry import query, rounded

KEYS = ["cohort", "model", "label"]

#: Shared by the oracles: counts by distinct score, then by label.
COUNTS = """counts AS (SELECT cohort, model, label, p, SUM(y) AS pos, SUM(1 - y) AS neg FROM {PRED} GROUP BY ALL)"""
AUROC = COUNTS + """, scan AS (
  SELECT *, SUM(neg) OVER (PARTITION BY cohort, model, label ORDER BY p ROWS UNBOUNDED PRECEDING) - neg AS below FROM counts
), auc AS (
  SELECT cohort, model, label, SUM(pos) AS pos, SUM(neg) AS neg,
         CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN SUM(pos * (below + neg * CAST(0.5 AS DOUBLE))) / (SUM(pos) * SUM(neg)) END AS auroc
  FROM scan GROUP BY ALL)"""
BINS = """binned AS (
  SELECT cohort, model, label, LEAST(CAST(FLOOR(p * 15) AS INT), 14) AS bin, COUNT(*) AS n, SUM(y) AS sum_y, SUM(p) AS sum_p, SUM((p - y) * (p - y)) AS sum_sq
  FROM {PRED} GROUP BY ALL)"""


def auroc_by_label(spark, sf_dir):
    return D.auroc(predictions(spark, sf_dir), KEYS)


@query("a01_weighted_auroc", f"""WITH counts AS (
  SELECT cohort, model, label, p, SUM((fold % 3) * y) AS pos, SUM((fold % 3) * (1 - y)) AS neg FROM {{PRED}} GROUP BY ALL
){AUROC.replace(COUNTS, "")} SELECT cohort, model, label, round(auroc, 6) AS auroc, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg FROM auc""")
def a01(spark, sf_dir):
    """Weights 0, 1, 2 by fold: weight 0 leaves rows out, 2 doubles them."""
    weighted = predictions(spark, sf_dir).withColumn("w", F.col("fold") % 3)
    return rounded(D.auroc(weighted, KEYS, weight="w"))


@query("a02_auroc", f"WITH {AUROC} SELECT cohort, model, label, round(auroc, 6) AS auroc, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg FROM auc")
def a02(spark, sf_dir):
    return rounded(auroc_by_label(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in ("pos", "neg")}))


@query("a03_average_precision", f"""WITH {COUNTS}, scan AS (
  SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp FROM counts WINDOW w AS (PARTITION BY cohort, model, label ORDER BY p DESC ROWS UNBOUNDED PRECEDING)
) SELECT cohort, model, label, CASE WHEN SUM(pos) > 0 THEN round(SUM(CAST(pos AS DOUBLE) * tp / (tp + fp)) / SUM(pos), 6) END AS ap FROM scan GROUP BY ALL""")
def a03(spark, sf_dir):
    return rounded(D.average_precision(predictions(spark, sf_dir), KEYS))


@query("a05_micro_auroc", """WITH counts AS (SELECT cohort, model, p, SUM(y) AS pos, SUM(1 - y) AS neg FROM {PRED} GROUP BY ALL), scan AS (
  SELECT *, SUM(neg) OVER (PARTITION BY cohort, model ORDER BY p ROWS UNBOUNDED PRECEDING) - neg AS below FROM counts
) SELECT cohort, model, round(SUM(pos * (below + neg * CAST(0.5 AS DOUBLE))) / (SUM(pos) * SUM(neg)), 6) AS micro_auroc FROM scan GROUP BY ALL""")
def a05(spark, sf_dir):
    return rounded(D.auroc(predictions(spark, sf_dir), ["cohort", "model"]).select("cohort", "model", F.col("auroc").alias("micro_auroc")))


@query("a06_macro_auroc", f"WITH {AUROC} SELECT cohort, model, round(AVG(auroc), 6) AS macro_auroc, COUNT(auroc) AS contributing FROM auc GROUP BY ALL")
def a06(spark, sf_dir):
    return rounded(D.macro(auroc_by_label(spark, sf_dir), ["cohort", "model"], "auroc"))


@query("a07_f1_threshold", f"""WITH {COUNTS}, more AS (
  SELECT * FROM counts UNION ALL SELECT cohort, model, label, t, 0, 0 FROM (SELECT DISTINCT cohort, model, label FROM counts) CROSS JOIN (SELECT CAST(0 AS DOUBLE) AS t UNION ALL SELECT CAST(1 AS DOUBLE))
), one AS (SELECT cohort, model, label, p, SUM(pos) AS pos, SUM(neg) AS neg FROM more GROUP BY ALL), scan AS (
  SELECT cohort, model, label, p, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY cohort, model, label) AS allpos
  FROM one WINDOW w AS (PARTITION BY cohort, model, label ORDER BY p DESC ROWS UNBOUNDED PRECEDING)
), rated AS (SELECT *, CASE WHEN tp + fp + allpos > 0 THEN CAST(2 AS DOUBLE) * tp / (tp + fp + allpos) ELSE 0 END AS f1 FROM scan),
best AS (SELECT *, MAX(f1) OVER (PARTITION BY cohort, model, label) AS best FROM rated)
SELECT cohort, model, label, round(MIN(p), 6) AS threshold, round(MAX(best), 6) AS f1 FROM best WHERE f1 >= best - 1e-12 GROUP BY ALL""")
def a07(spark, sf_dir):
    return rounded(D.f1_thresholds(predictions(spark, sf_dir), KEYS))


CONFUSION = """conf AS (SELECT cohort, model, label,
  CAST(COUNT(*) FILTER (WHERE p >= CAST(0.5 AS DOUBLE) AND y = 1) AS DOUBLE) AS tp, CAST(COUNT(*) FILTER (WHERE p >= CAST(0.5 AS DOUBLE) AND y = 0) AS DOUBLE) AS fp,
  CAST(COUNT(*) FILTER (WHERE p < CAST(0.5 AS DOUBLE) AND y = 0) AS DOUBLE) AS tn, CAST(COUNT(*) FILTER (WHERE p < CAST(0.5 AS DOUBLE) AND y = 1) AS DOUBLE) AS fn
  FROM {PRED} GROUP BY ALL)"""


@query("a08_thresholded_metrics", f"""WITH {CONFUSION}, r AS (SELECT *, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, tp / nullif(tp + fn, 0) AS sens, tn / nullif(tn + fp, 0) AS spec FROM conf)
SELECT cohort, model, round(AVG(f1), 6) AS macro_f1, round(AVG(sens), 6) AS macro_sensitivity, round(AVG(spec), 6) AS macro_specificity,
  round(2 * SUM(tp) / nullif(2 * SUM(tp) + SUM(fp) + SUM(fn), 0), 6) AS micro_f1 FROM r GROUP BY ALL""")
def a08(spark, sf_dir):
    counts = D.operating_ratios(D.confusion(predictions(spark, sf_dir), KEYS, F.lit(0.5)))
    return rounded(counts.groupBy("cohort", "model").agg(
        F.avg("f1").alias("macro_f1"), F.avg("sensitivity").alias("macro_sensitivity"), F.avg("specificity").alias("macro_specificity"),
        F.try_divide(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"),
    ))


@query("a09_equal_width_ece", f"WITH {BINS} SELECT cohort, model, label, round(SUM(ABS(sum_y - sum_p)) / SUM(n), 6) AS ece, round(SUM(sum_sq) / SUM(n), 6) AS brier, CAST(SUM(n) AS BIGINT) AS n FROM binned GROUP BY ALL")
def a09(spark, sf_dir):
    return rounded(C.calibration(predictions(spark, sf_dir), KEYS).withColumn("n", F.col("n").cast("long")))


@query("a10_calibration_summary", f"""WITH {BINS}, lab AS (SELECT cohort, model, label, SUM(ABS(sum_y - sum_p)) / SUM(n) AS ece, SUM(sum_sq) / SUM(n) AS brier FROM binned GROUP BY ALL),
pool AS (SELECT cohort, model, SUM(ABS(y - p)) / SUM(n) AS pooled_ece, SUM(sq) / SUM(n) AS pooled_brier FROM (
  SELECT cohort, model, bin, SUM(n) AS n, SUM(sum_y) AS y, SUM(sum_p) AS p, SUM(sum_sq) AS sq FROM binned GROUP BY ALL) GROUP BY ALL)
SELECT cohort, model, round(AVG(ece), 6) AS macro_ece, round(AVG(brier), 6) AS macro_brier, COUNT(ece) AS labels, round(MAX(pooled_ece), 6) AS pooled_ece, round(MAX(pooled_brier), 6) AS pooled_brier
FROM lab JOIN pool USING (cohort, model) GROUP BY ALL""")
def a10(spark, sf_dir):
    return rounded(C.calibration_summary(predictions(spark, sf_dir), ["cohort", "model"]))


@query("a12_bin_basis", """SELECT cluster_id, model, label, LEAST(CAST(FLOOR(p * 15) AS INT), 14) AS bin, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(y) AS BIGINT) AS sum_y, round(SUM(p), 6) AS sum_p
FROM {PRED} WHERE cohort = 'F' GROUP BY ALL""")
def a12(spark, sf_dir):
    """Per-cluster totals, from which every resample's calibration follows by weighted sums."""
    rows = predictions(spark, sf_dir).where("cohort = 'F'")
    totals = C.bin_totals(rows, ["cluster_id", "model", "label"]).drop("sum_sq")
    return rounded(totals.withColumns({c: F.col(c).cast("long") for c in ("n", "sum_y")}))


@query("a18_weighted_calibration", """WITH b AS (SELECT cohort, model, LEAST(CAST(FLOOR(p * 15) AS INT), 14) AS bin, SUM(fold % 4) AS n, SUM((fold % 4) * y) AS sy, SUM((fold % 4) * p) AS sp, SUM((fold % 4) * (p - y) * (p - y)) AS sq FROM {PRED} GROUP BY ALL)
SELECT cohort, model, round(SUM(ABS(sy - sp)) / SUM(n), 6) AS ece, round(SUM(sq) / SUM(n), 6) AS brier, CAST(SUM(n) AS DOUBLE) AS n FROM b GROUP BY ALL""")
def a18(spark, sf_dir):
    weighted = predictions(spark, sf_dir).withColumn("w", F.col("fold") % 4)
    return rounded(C.calibration(weighted, ["cohort", "model"], weight="w"))


@query("a19_mean_nll", """WITH c AS (SELECT cohort, model, label, y, LEAST(GREATEST(p, 1e-7), 1 - 1e-7) AS q FROM {PRED})
SELECT cohort, model, label, round(AVG(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS nll FROM c GROUP BY ALL""")
def a19(spark, sf_dir):
    return rounded(C.mean_nll(predictions(spark, sf_dir), KEYS))


@query("a20_reliability_table", f"""WITH {BINS}, b AS (SELECT cohort, model, label, bin, n, sum_y, sum_p FROM binned UNION ALL SELECT cohort, model, 'pooled', bin, SUM(n), SUM(sum_y), SUM(sum_p) FROM binned GROUP BY cohort, model, bin),
s AS (SELECT cohort, model, label, CAST(range AS INT) AS bin FROM (SELECT DISTINCT cohort, model, label FROM b) CROSS JOIN range(15))
SELECT cohort, model, label, bin, round(bin / CAST(15 AS DOUBLE), 6) AS low, round((bin + 1) / CAST(15 AS DOUBLE), 6) AS high, CAST(coalesce(n, 0) AS BIGINT) AS count, round(round(sum_p, 9) / n, 6) AS mean_p, round(sum_y / CAST(n AS DOUBLE), 6) AS rate
FROM s LEFT JOIN b USING (cohort, model, label, bin)""")
def a20(spark, sf_dir):
    return rounded(C.reliability(predictions(spark, sf_dir), ["cohort", "model"]))


@query("a46_constant_floor", """WITH r AS (SELECT *, AVG(y) OVER (PARTITION BY cohort, model, label) AS q FROM {PRED}), b AS (SELECT cohort, model, label, LEAST(CAST(FLOOR(q * 15) AS INT), 14) AS bin, COUNT(*) AS n, SUM(y) AS sy, SUM(q) AS sp, SUM((q - y) * (q - y)) AS sq FROM r GROUP BY ALL),
l AS (SELECT cohort, model, label, round(SUM(ABS(sy - sp)) / SUM(n), 9) AS ece, SUM(sq) / SUM(n) AS brier FROM b GROUP BY ALL)
SELECT cohort, model, round(AVG(ece), 6) + 0 AS macro_ece, round(AVG(brier), 6) AS macro_brier, COUNT(ece) AS labels FROM l GROUP BY ALL""")
def a46(spark, sf_dir):
    return rounded(C.constant_floor(predictions(spark, sf_dir), ["cohort", "model"]).select("cohort", "model", "macro_ece", "macro_brier", "labels"))


@query("a47_ece_shares", f"WITH {BINS}, e AS (SELECT cohort, model, label, SUM(ABS(sum_y - sum_p)) / SUM(n) AS ece FROM binned GROUP BY ALL) SELECT cohort, model, label, round(ece / SUM(ece) OVER (PARTITION BY cohort, model), 6) AS share FROM e")
def a47(spark, sf_dir):
    return rounded(C.shares(C.calibration(predictions(spark, sf_dir), KEYS), ["cohort", "model"], "ece").select(*KEYS, "share"))


@query("a50_equal_mass_ece", f"""WITH pr AS (SELECT * FROM {{PRED}}), e AS (SELECT cohort, model, label, list_distinct(quantile_cont(p, [{', '.join(f'CAST({k} AS DOUBLE) / 15' for k in range(1, 15))}])) AS edges FROM pr GROUP BY ALL),
b AS (SELECT cohort, model, label, len(list_filter(edges, lambda x: x <= p)) AS bin, COUNT(*) AS n, SUM(y) AS sy, SUM(p) AS sp FROM pr JOIN e USING (cohort, model, label) GROUP BY ALL)
SELECT cohort, model, label, round(SUM(ABS(sy - sp)) / SUM(n), 6) AS ece FROM b GROUP BY ALL""")
def a50(spark, sf_dir):
    return rounded(C.equal_mass_calibration(predictions(spark, sf_dir), KEYS).select(*KEYS, "ece"))


@query("a53_variant_contrast", """WITH v AS (SELECT cohort, model, 'raw' AS variant, y, p FROM {PRED} UNION ALL SELECT cohort, model, 'scaled', y, 1 / (1 + exp(-ln(q / (1 - q)) / CAST(1.3 AS DOUBLE))) FROM (SELECT cohort, model, y, LEAST(GREATEST(p, 1e-7), 1 - 1e-7) AS q FROM {PRED})),
b AS (SELECT cohort, model, variant, AVG((p - y) * (p - y)) AS brier FROM v GROUP BY ALL)
SELECT cohort, model, round(MAX(CASE WHEN variant = 'raw' THEN brier END), 6) AS raw, round(MAX(CASE WHEN variant = 'scaled' THEN brier END), 6) AS scaled,
 round(MAX(CASE WHEN variant = 'scaled' THEN brier END) - MAX(CASE WHEN variant = 'raw' THEN brier END), 6) AS change FROM b GROUP BY ALL""")
def a53(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("cohort", "model", "y", "p")
    both = rows.withColumn("variant", F.lit("raw")).union(rows.withColumn("p", scalar.temperature_scaled(F.col("p"), 1.3)).withColumn("variant", F.lit("scaled")))
    wide = both.groupBy("cohort", "model").pivot("variant", ["raw", "scaled"]).agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))))
    return rounded(wide.withColumn("change", F.col("scaled") - F.col("raw")))


@query("a33_operating_points", f"""WITH {CONFUSION} SELECT cohort, model, label, tp, fp, tn, fn, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(tn / nullif(tn + fn, 0), 6) AS npv,
 round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + fn) / (tp + fp + tn + fn), 6) AS prevalence, round((tp + fp) / (tp + fp + tn + fn), 6) AS flag_rate, round((tp + fp) / nullif(tp, 0), 6) AS alarms_per_true FROM conf""")
def a33(spark, sf_dir):
    return rounded(D.operating_ratios(D.confusion(predictions(spark, sf_dir), KEYS, F.lit(0.5))))


@query("a34_hard_rule_rates", """SELECT cohort, model, label, round(AVG(CASE WHEN y = 1 THEN CAST(p >= CAST(0.6 AS DOUBLE) AS INT) END), 6) AS tpr, round(AVG(CASE WHEN y = 0 THEN CAST(p >= CAST(0.6 AS DOUBLE) AS INT) END), 6) AS fpr FROM {PRED} GROUP BY ALL""")
def a34(spark, sf_dir):
    flag = (F.col("p") >= 0.6).cast("double")
    return rounded(predictions(spark, sf_dir).groupBy(*KEYS).agg(F.avg(F.when(F.col("y") == 1, flag)).alias("tpr"), F.avg(F.when(F.col("y") == 0, flag)).alias("fpr")))


@query("k09_sensitivity_floor", f"""WITH {COUNTS}, s AS (SELECT *, SUM(pos) OVER (PARTITION BY cohort, model, label ORDER BY p DESC ROWS UNBOUNDED PRECEDING) / nullif(CAST(SUM(pos) OVER (PARTITION BY cohort, model, label) AS DOUBLE), 0) AS share FROM counts),
t AS (SELECT cohort, model, label, MAX(CASE WHEN share >= CAST(0.9 AS DOUBLE) THEN p END) AS t FROM s GROUP BY ALL)
SELECT cohort, model, label, round(coalesce(t, 0), 6) AS threshold, t IS NOT NULL AS met FROM t""")
def k09(spark, sf_dir):
    return rounded(D.sensitivity_floor(predictions(spark, sf_dir), KEYS, 0.9))


@query("w03_midranks", """WITH r AS (SELECT DISTINCT cohort, model, label, record_id, p FROM {PRED}), m AS (
 SELECT *, (2 * CAST(RANK() OVER (PARTITION BY cohort, model, label ORDER BY p) AS DOUBLE) + COUNT(*) OVER (PARTITION BY cohort, model, label, p) - 3) / 2 / GREATEST(COUNT(*) OVER (PARTITION BY cohort, model, label) - 1, 1) AS midrank FROM r)
SELECT cohort, model, label, record_id, round(midrank, 6) AS midrank FROM m""")
def w03(spark, sf_dir):
    return rounded(D.midranks(predictions(spark, sf_dir), KEYS).select(*KEYS, "record_id", "midrank"))
