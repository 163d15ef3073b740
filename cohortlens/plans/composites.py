"""Composite analyses: tables over subgroups, variants and replicates, each one pass with one more grouping key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import bootstrap as B
from ..operators import calibration as C
from ..operators import discrimination as D
from ..operators import fitting
from ..operators import labels as L
from ..operators import utility as U
from ..operators.lineage import cut
from ..sources.adapters import orders, people, predictions, predictions_of
from .registry import query, rounded
from .studies import CURVE, ECE_BOOT, REPLICATES, WEIGHTS, BOOT_AUC, P_VALUES, boot, boot_sql, interval_sql, shift_changes

KEYS = ["cohort", "model", "label"]
UNIT = ["cohort", "model"]


def auc_sql(rows: str, keys: str, name: str) -> str:
    """CTEs (keys, pos, neg, auroc) as name over rows."""
    return f"""{name}_c AS (SELECT {keys}, p, SUM(y) AS pos, SUM(1 - y) AS neg FROM ({rows}) GROUP BY ALL), {name}_s AS (SELECT *, SUM(neg) OVER (PARTITION BY {keys} ORDER BY p ROWS UNBOUNDED PRECEDING) - neg AS below FROM {name}_c),
 {name} AS (SELECT {keys}, SUM(pos) AS pos, SUM(neg) AS neg, CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN SUM(pos * (below + neg * CAST(0.5 AS DOUBLE))) / (SUM(pos) * SUM(neg)) END AS auroc FROM {name}_s GROUP BY ALL)"""


def ece_sql(rows: str, keys: str, name: str) -> str:
    return f"""{name}_b AS (SELECT {keys}, LEAST(CAST(FLOOR(p * 15) AS INT), 14) AS bin, COUNT(*) AS n, SUM(y) AS sy, SUM(p) AS sp, SUM((p - y) * (p - y)) AS sq FROM ({rows}) GROUP BY ALL), {name} AS (SELECT {keys}, SUM(ABS(sy - sp)) / SUM(n) AS ece, SUM(sq) / SUM(n) AS brier FROM {name}_b GROUP BY ALL)"""


# --- replicates


@query("b05_micro_replicates", f"WITH {WEIGHTS}, {boot_sql('SELECT * FROM {PRED}', UNIT[0] + ', ' + UNIT[1])} SELECT cohort, model, {interval_sql('auroc')} FROM boot GROUP BY ALL")
def b05(spark, sf_dir):
    """All labels' rows in one ranking, a record's weight on each of its pairs."""
    return rounded(B.interval(B.replicate_auroc(predictions(spark, sf_dir), UNIT, REPLICATES), UNIT, "auroc"))


RECONCILED = """rec AS (SELECT cohort, record_id, MAX(CASE WHEN label = 'returned' THEN y END) AS own, MAX(CASE WHEN label = 'large' THEN y END) AS other FROM {PRED} WHERE model = 'size' GROUP BY ALL),
 rp AS (SELECT cohort, record_id, cluster_id, model, p, own, other FROM {PRED} JOIN rec USING (cohort, record_id) WHERE label = 'returned'),
 est AS (SELECT cohort, model, cluster_id, record_id, p, 'as_labelled' AS estimand, own AS y FROM rp UNION ALL SELECT cohort, model, cluster_id, record_id, p, 'union', GREATEST(own, other) FROM rp UNION ALL SELECT cohort, model, cluster_id, record_id, p, 'restricted', own FROM rp WHERE other = 0)"""


def estimands(spark, sf_dir):
    """Rows by estimand: the label as it is, the union target, and records without the competing label."""
    rows = predictions(spark, sf_dir)
    targets = L.reconciled(rows.where("model = 'size'"), ["cohort", "record_id"], "returned", ["large"])
    own = rows.where("label = 'returned'").drop("y").join(targets, ["cohort", "record_id"])
    kinds = F.array(
        F.struct(F.lit("as_labelled").alias("estimand"), F.col("y").alias("y")), F.struct(F.lit("union").alias("estimand"), F.col("y_union").alias("y")),
        F.when(F.col("keep"), F.struct(F.lit("restricted").alias("estimand"), F.col("y").alias("y"))),
    )
    return own.select("cohort", "model", "cluster_id", "record_id", "p", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("*", "k.*").drop("k")


@query("b07_masked_replicates", f"WITH {RECONCILED}, {WEIGHTS}, {boot_sql(chr(10) + ' SELECT * FROM est', 'cohort, model, estimand')} SELECT cohort, model, estimand, {interval_sql('auroc')} FROM boot GROUP BY ALL")
def b07(spark, sf_dir):
    """Several estimands, masked ones among them, in one pass of the resamples."""
    keys = [*UNIT, "estimand"]
    return rounded(B.interval(B.replicate_auroc(estimands(spark, sf_dir), keys, REPLICATES), keys, "auroc"))


@query("q12_reconciled_shift", f"""WITH {RECONCILED}, {auc_sql('SELECT * FROM est', 'cohort, model, estimand', 'a')}, {WEIGHTS}, {boot_sql('SELECT * FROM est', 'cohort, model, estimand')},
 d AS (SELECT x.cohort, model, estimand, x.auroc - i.auroc AS change FROM boot x JOIN boot i USING (model, estimand, replicate) WHERE i.cohort = 'F' AND x.cohort <> 'F'), iv AS (SELECT cohort, model, estimand, round(quantile_cont(change, 0.025), 6) AS lower, round(quantile_cont(change, 0.975), 6) AS upper FROM d GROUP BY ALL)
SELECT x.cohort, model, estimand, round(x.auroc, 6) AS auroc, round(x.auroc - i.auroc, 6) AS change, lower, upper FROM a x JOIN a i USING (model, estimand) JOIN iv ON iv.cohort = x.cohort AND iv.model = x.model AND iv.estimand = x.estimand WHERE i.cohort = 'F' AND x.cohort <> 'F'""".replace("SELECT x.cohort, model, estimand, round(x.auroc", "SELECT x.cohort, x.model, x.estimand, round(x.auroc"))
def q12(spark, sf_dir):
    rows, by = estimands(spark, sf_dir), ["model", "estimand"]
    points = D.auroc(rows, ["cohort", *by])
    reps = B.replicate_auroc(rows, ["cohort", *by], REPLICATES)
    inside = lambda df, keys: df.where("cohort = 'F'").select(*keys, F.col("auroc").alias("inside"))
    change = lambda df, keys: df.where("cohort <> 'F'").join(inside(df, keys), keys).withColumn("change", F.col("auroc") - F.col("inside"))
    bounds = B.interval(change(reps, [*by, "replicate"]), ["cohort", *by], "change").select("cohort", *by, "lower", "upper")
    return rounded(change(points, by).join(bounds, ["cohort", *by]).select("cohort", *by, "auroc", "change", "lower", "upper"))


MEMBERS = {"all": ["returned", "large", "urgent"], "without_urgent": ["returned", "large"], "single": ["large"]}
MEMBERS_SQL = "mem AS (" + " UNION ALL ".join(f"SELECT '{k}' AS variant, '{x}' AS label" for k, v in MEMBERS.items() for x in v) + ")"


@query("q13_macro_variants", f"WITH {BOOT_AUC}, {MEMBERS_SQL}, m AS (SELECT cohort, model, variant, replicate, AVG(auroc) AS macro FROM boot JOIN mem USING (label) GROUP BY ALL) SELECT cohort, model, variant, {interval_sql('macro')} FROM m GROUP BY ALL")
def q13(spark, sf_dir):
    """Means over several sets of labels, from one table of replicates."""
    sets = spark.createDataFrame([(k, x) for k, v in MEMBERS.items() for x in v], "variant string, label string")
    macro = D.macro(boot(spark, sf_dir).join(F.broadcast(sets), "label"), [*UNIT, "variant", "replicate"], "auroc")
    return rounded(B.interval(macro, [*UNIT, "variant"], "macro_auroc"))


@query("q14_conditional_annotation", "WITH o AS (SELECT * FROM {ORDERS}) SELECT cohort, round(AVG(y_large) FILTER (WHERE y_returned = 1), 6) AS large_if_returned, round(AVG(y_large) FILTER (WHERE y_returned = 0), 6) AS large_if_not FROM o GROUP BY cohort")
def q14(spark, sf_dir):
    given = lambda v: F.avg(F.when(F.col("y_returned") == v, F.col("y_large")))
    return rounded(orders(spark, sf_dir).groupBy("cohort").agg(given(1).alias("large_if_returned"), given(0).alias("large_if_not")))


PASS = f"""{BOOT_AUC}, m AS (SELECT cohort, model, replicate, AVG(auroc) AS macro_auroc, COUNT(auroc) AS labels FROM boot GROUP BY ALL), {ECE_BOOT},
 pass AS (SELECT cohort, model, replicate, macro_auroc, labels, ece, brier FROM m JOIN eboot USING (cohort, model, replicate))"""


def cohort_pass(spark, sf_dir):
    """Macro AUROC, its labels, pooled ECE and Brier score of every replicate, all from one set of resamples."""
    macro = D.macro(boot(spark, sf_dir), [*UNIT, "replicate"], "auroc").withColumnRenamed("contributing", "labels")
    totals = C.bin_totals(predictions(spark, sf_dir), ["cluster_id", *UNIT])
    sums = B.replicate_sums(totals, [*UNIT, "bin"], ["n", "sum_y", "sum_p", "sum_sq"], REPLICATES)
    return macro.join(C.from_totals(sums, [*UNIT, "replicate"]).drop("n"), [*UNIT, "replicate"])


@query("b03_cohort_pass", f"WITH {PASS} SELECT cohort, model, replicate, round(macro_auroc, 6) AS macro_auroc, labels, round(ece, 6) AS ece, round(brier, 6) AS brier FROM pass")
def b03p(spark, sf_dir):
    return rounded(cohort_pass(spark, sf_dir))


WIDE = ("macro_auroc", "ece", "brier")


@query("q04_cohort_table", f"""WITH {auc_sql("SELECT * FROM {PRED} WHERE label <> 'never'", "cohort, model, label", "a")}, {ece_sql("SELECT * FROM {PRED}", "cohort, model", "e")}, pt AS (SELECT cohort, model, AVG(auroc) AS macro_auroc FROM a GROUP BY ALL), {PASS}
SELECT pt.cohort, pt.model, {", ".join(f"round(MAX({t}.{c}), 6) AS {c}, round(quantile_cont(pass.{c}, 0.025), 6) AS {c}_lower_95, round(quantile_cont(pass.{c}, 0.975), 6) AS {c}_upper_95" for c, t in zip(WIDE, ("pt", "e", "e")))},
 COUNT(*) FILTER (WHERE labels < 3) AS replicates_below, MIN(labels) AS least_labels FROM pt JOIN e ON e.cohort = pt.cohort AND e.model = pt.model JOIN pass ON pass.cohort = pt.cohort AND pass.model = pt.model GROUP BY pt.cohort, pt.model""")
def q04(spark, sf_dir):
    """One row a cohort and model: points, their intervals with suffixes, and replicates that lack a registered label."""
    rows = predictions(spark, sf_dir)
    points = D.macro(D.auroc(rows.where("label <> 'never'"), KEYS), UNIT, "auroc").select(*UNIT, "macro_auroc").join(C.calibration(rows, UNIT).drop("n"), UNIT)
    # Written once: its replicates are read four times.
    reps = cut(cohort_pass(spark, sf_dir))
    bounds = None
    for name in WIDE:
        own = B.interval(reps, UNIT, name).select(*UNIT, F.col("lower").alias(f"{name}_lower_95"), F.col("upper").alias(f"{name}_upper_95"))
        bounds = own if bounds is None else bounds.join(own, UNIT)
    below = reps.groupBy(*UNIT).agg(F.count_if(F.col("labels") < 3).alias("replicates_below"), F.min("labels").alias("least_labels"))
    wide = points.join(bounds, UNIT).join(below, UNIT)
    return rounded(wide.select(*UNIT, *[f"{n}{x}" for n in WIDE for x in ("", "_lower_95", "_upper_95")], "replicates_below", "least_labels"))


@query("q07_hospital_difference", f"WITH {BOOT_AUC}, m AS (SELECT cohort, replicate, model, AVG(auroc) AS macro FROM boot GROUP BY ALL), d AS (SELECT model, a.macro - b.macro AS change FROM m a JOIN m b USING (replicate, model) WHERE a.cohort = 'O' AND b.cohort = 'P') SELECT model, {interval_sql('change')} FROM d GROUP BY model")
def q07c(spark, sf_dir):
    macro = D.macro(boot(spark, sf_dir), ["cohort", "replicate", "model"], "auroc")
    return rounded(B.interval(B.contrast(macro, ["model", "replicate"], "cohort", "O", "P", "macro_auroc"), ["model"], "change"))


@query("q09_label_shift_deltas", f"WITH {BOOT_AUC}, {P_VALUES}, i AS (SELECT cohort, model, label, quantile_cont(change, 0.025) AS lo, quantile_cont(change, 0.975) AS hi FROM dl GROUP BY ALL) SELECT cohort, model, label, round(lo, 6) AS lower, round(hi, 6) AS upper, lo > 0 OR hi < 0 AS excludes_zero, round(p_value, 6) AS p_value FROM i JOIN pv USING (cohort, model, label)")
def q09b(spark, sf_dir):
    change = shift_changes(spark, sf_dir)
    rows = B.interval(change, KEYS, "change").join(B.p_value(change, KEYS, "change"), KEYS)
    return rounded(rows.select(*KEYS, "lower", "upper", ((F.col("lower") > 0) | (F.col("upper") < 0)).alias("excludes_zero"), "p_value"))


PEOPLE_ROWS = """sub AS (SELECT r.*, factor, level FROM {PRED} r JOIN (SELECT person_id AS cluster_id, 'sex' AS factor, CASE WHEN sex_code = 0 THEN 'male' ELSE 'female' END AS level FROM {PEOPLE} UNION ALL SELECT person_id, 'age', CASE WHEN age < 40 THEN 'under_40' WHEN age < 65 THEN '40_to_64' ELSE '65_plus' END FROM {PEOPLE}) USING (cluster_id))"""


def subgroups(spark, sf_dir, rows=None):
    """Every row once a factor, with its level; of all predictions, unless rows are given."""
    levels = people(spark, sf_dir).select(
        F.col("person_id").alias("cluster_id"),
        F.explode(F.array(
            F.struct(F.lit("sex").alias("factor"), scalar.sex_name(F.col("sex_code")).alias("level")),
            F.struct(F.lit("age").alias("factor"), scalar.age_band(F.col("age").cast("string")).alias("level")),
        )).alias("f"),
    ).select("cluster_id", "f.*")
    return (predictions(spark, sf_dir) if rows is None else rows).join(levels, "cluster_id")


@query("q08_subgroup_metrics", f"""WITH {PEOPLE_ROWS}, ok AS (SELECT cohort, model, factor, label FROM (SELECT cohort, model, factor, level, label, SUM(y) AS pos, SUM(1 - y) AS neg FROM sub GROUP BY ALL) GROUP BY ALL HAVING MIN(LEAST(pos, neg)) >= 5),
 com AS (SELECT sub.* FROM sub SEMI JOIN ok USING (cohort, model, factor, label)), {auc_sql("SELECT * FROM com", "cohort, model, factor, level, label", "a")}, pt AS (SELECT cohort, model, factor, level, AVG(auroc) AS macro_auroc, COUNT(auroc) AS labels FROM a GROUP BY ALL),
 {ece_sql("SELECT * FROM com", "cohort, model, factor, level", "e")}, n AS (SELECT cohort, model, factor, level, COUNT(DISTINCT record_id) AS records FROM sub GROUP BY ALL), {WEIGHTS}, {boot_sql("SELECT * FROM com", "cohort, model, factor, level, label")}, mb AS (SELECT cohort, model, factor, level, replicate, AVG(auroc) AS m FROM boot GROUP BY ALL),
 iv AS (SELECT cohort, model, factor, level, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM mb GROUP BY ALL)
SELECT cohort, model, factor, level, records, labels, round(macro_auroc, 6) AS macro_auroc, lower, upper, round(ece, 6) AS ece FROM pt JOIN e USING (cohort, model, factor, level) JOIN n USING (cohort, model, factor, level) JOIN iv USING (cohort, model, factor, level)""")
def q08(spark, sf_dir):
    """By level of each factor, over the labels that all levels of the factor support."""
    # Five tables read the rows: a row an order is written once, and the labels that are supported, a few, too.
    rows, keys = subgroups(spark, sf_dir, predictions_of(cut(orders(spark, sf_dir)))), [*UNIT, "factor", "level"]
    support = rows.groupBy(*keys, "label").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    support = cut(support.groupBy(*UNIT, "factor", "label").agg(F.min(F.least("pos", "neg")).alias("least")).where("least >= 5").drop("least"))
    common = rows.join(support, [*UNIT, "factor", "label"], "left_semi")
    points = D.macro(D.auroc(common, [*keys, "label"]), keys, "auroc").withColumnRenamed("contributing", "labels")
    reps = D.macro(B.replicate_auroc(common, [*keys, "label"], REPLICATES), [*keys, "replicate"], "auroc")
    bounds = B.interval(reps, keys, "macro_auroc").select(*keys, "lower", "upper")
    records = rows.groupBy(*keys).agg(F.countDistinct("record_id").alias("records"))
    out = points.join(C.calibration(common, keys).select(*keys, "ece"), keys).join(records, keys).join(bounds, keys)
    return rounded(out.select(*keys, "records", "labels", "macro_auroc", "lower", "upper", "ece"))


@query("r03_subgroup_pivot", f"""WITH {PEOPLE_ROWS}, {auc_sql("SELECT * FROM sub", "cohort, model, factor, level, label", "a")}, m AS (SELECT cohort, factor, level, model, AVG(auroc) AS macro FROM a GROUP BY ALL)
SELECT cohort, factor, level, CAST(list_position(['F', 'O', 'P'], cohort) AS INT) AS place, round(MAX(macro) FILTER (WHERE model = 'size'), 6) AS size, round(MAX(macro) FILTER (WHERE model = 'discount'), 6) AS discount FROM m GROUP BY ALL""")
def r03(spark, sf_dir):
    """A row a subgroup, a column a model, in the cohorts' own order."""
    keys = ["cohort", "factor", "level"]
    macro = D.macro(D.auroc(subgroups(spark, sf_dir), [*keys, "model", "label"]), [*keys, "model"], "auroc")
    wide = macro.groupBy(*keys).pivot("model", ["size", "discount"]).agg(F.max("macro_auroc"))
    place = F.array_position(F.array(*map(F.lit, "FOP")), F.col("cohort")).cast("int")
    return rounded(wide.select(*keys, place.alias("place"), "size", "discount").orderBy("place", "factor", "level"))


# --- recalibrated scores and fused passes

RUNG_SQL = """src AS (SELECT model, label, AVG(y) AS source FROM {PRED} WHERE cohort = 'F' AND fold <= 8 GROUP BY ALL), tgt AS (SELECT cohort, model, label, AVG(y) AS target FROM {PRED} GROUP BY ALL),
 clip AS (SELECT cohort, model, label, LEAST(GREATEST(source, 1e-6), 1 - 1e-6) AS s, LEAST(GREATEST(target, 1e-6), 1 - 1e-6) AS t FROM tgt JOIN src USING (model, label)),
 rung AS (SELECT cohort, model, label, 'none' AS rung, CAST(NULL AS DOUBLE) AS slope, CAST(NULL AS DOUBLE) AS shift FROM clip UNION ALL SELECT cohort, model, label, 'halved', CAST(0.5 AS DOUBLE), CAST(0 AS DOUBLE) FROM clip
  UNION ALL SELECT cohort, model, label, 'known_prior', CAST(1 AS DOUBLE), ln(t / (1 - t)) - ln(s / (1 - s)) FROM clip),
 rr AS (SELECT cohort, model, label, rung, cluster_id, y, CASE WHEN slope IS NULL THEN p ELSE 1 / (1 + exp(-(slope * ln(LEAST(GREATEST(p, 1e-7), 1 - 1e-7) / (1 - LEAST(GREATEST(p, 1e-7), 1 - 1e-7))) + shift))) END AS p FROM {PRED} JOIN rung USING (cohort, model, label))"""


def given_rungs(spark, sf_dir):
    """Three rungs that need no fit: as they are, logits halved, and moved to the target's prevalence."""
    rows, by = predictions(spark, sf_dir), ["model", "label"]
    source = rows.where("cohort = 'F' and fold <= 8").groupBy(*by).agg(F.avg("y").alias("source"))
    both = rows.groupBy(*KEYS).agg(F.avg("y").alias("target")).join(source, by)
    each = F.array(
        F.struct(F.lit("none").alias("rung"), F.lit(None).cast("double").alias("slope"), F.lit(None).cast("double").alias("offset")),
        F.struct(F.lit("halved").alias("rung"), F.lit(0.5).alias("slope"), F.lit(0.0).alias("offset")),
        F.struct(F.lit("known_prior").alias("rung"), F.lit(1.0).alias("slope"), scalar.prior_shift_offset(F.col("source"), F.col("target")).alias("offset")),
    )
    return both.select(*KEYS, F.explode(each).alias("r")).select(*KEYS, "r.*")


def rung_intervals(rows, rungs, names, replicates):
    """cohort, model, rung: bounds of the mean calibration error over labels."""
    ece = B.rung_replicates(rows, rungs, names, KEYS, replicates)
    by = [*UNIT, "rung"]
    return B.interval(D.macro(ece, [*by, "replicate"], "ece"), by, "macro_ece")


@query("b11_rung_intervals", f"""WITH {RUNG_SQL}, {WEIGHTS}, t AS (SELECT cohort, model, label, rung, cluster_id, LEAST(CAST(FLOOR(p * 15) AS INT), 14) AS bin, COUNT(*) AS n, SUM(y) AS sy, SUM(p) AS sp FROM rr GROUP BY ALL),
 ws AS (SELECT cohort, model, label, rung, replicate, bin, SUM(w * n) AS n, SUM(w * sy) AS sy, SUM(w * sp) AS sp FROM t JOIN w USING (cluster_id) GROUP BY ALL), e AS (SELECT cohort, model, label, rung, replicate, SUM(ABS(sy - sp)) / nullif(SUM(n), 0) AS ece FROM ws GROUP BY ALL),
 m AS (SELECT cohort, model, rung, replicate, AVG(ece) AS ece FROM e GROUP BY ALL) SELECT cohort, model, rung, {interval_sql('ece')} FROM m GROUP BY ALL""")
def b11(spark, sf_dir):
    """Every rung's error by replicate from one product of weights."""
    return rounded(rung_intervals(predictions(spark, sf_dir), given_rungs(spark, sf_dir), ["none", "halved", "known_prior"], REPLICATES))


@query("q23_rung_intervals")
def q23_intervals(spark, sf_dir):
    """The nine fitted rungs' intervals."""
    rows = predictions(spark, sf_dir)
    return rounded(rung_intervals(rows, fitting.ladder_rungs(rows, ["model"], "F"), fitting.RUNGS, REPLICATES))


# --- utility and operating points

AT = (0.1, 0.3, 0.5)
AT_SQL = "g AS (" + " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS t" for t in AT) + ")"


@query("q21_utility_intervals", f"""WITH {WEIGHTS}, {AT_SQL}, b AS (SELECT cohort, model, label, cluster_id, t, COUNT(*) FILTER (WHERE p >= t AND y = 1) AS tp, COUNT(*) FILTER (WHERE p >= t AND y = 0) AS fp, SUM(y) AS pos, COUNT(*) AS n FROM {{PRED}} CROSS JOIN g GROUP BY ALL),
 s AS (SELECT cohort, model, label, t, replicate, SUM(w * tp) AS tp, SUM(w * fp) AS fp, SUM(w * pos) AS pos, CAST(SUM(w * n) AS DOUBLE) AS n FROM b JOIN w USING (cluster_id) GROUP BY ALL), u AS (SELECT cohort, model, label, t, tp / n - fp / n * (t / (1 - t)) AS net_benefit, GREATEST(pos / n - (n - pos) / n * (t / (1 - t)), 0) AS usual FROM s)
SELECT cohort, model, label, t, round(quantile_cont(net_benefit, 0.025), 6) AS lower, round(quantile_cont(net_benefit, 0.975), 6) AS upper, round(quantile_cont(net_benefit - usual, 0.025), 6) AS gain_lower, round(quantile_cont(net_benefit - usual, 0.975), 6) AS gain_upper FROM u GROUP BY ALL""")
def q21b(spark, sf_dir):
    """Net benefit and its gain over the better default at three thresholds: counts by cluster, then weights."""
    keys = [*KEYS, "t"]
    sums = B.replicate_sums(U.threshold_basis(predictions(spark, sf_dir), KEYS, AT), keys, ["tp", "fp", "pos", "n"], REPLICATES)
    rows = cut(U.from_basis(sums))
    bounds = B.interval(rows, keys, "net_benefit").select(*keys, "lower", "upper")
    gains = B.interval(rows, keys, "gain").select(*keys, F.col("lower").alias("gain_lower"), F.col("upper").alias("gain_upper"))
    return rounded(bounds.join(gains, keys))


BENEFIT_BOOT = """b AS (SELECT cohort, model, label, cluster_id, t, COUNT(*) FILTER (WHERE p >= t AND y = 1) AS tp, COUNT(*) FILTER (WHERE p >= t AND y = 0) AS fp, COUNT(*) AS n FROM {PRED} CROSS JOIN g GROUP BY ALL),
 s AS (SELECT cohort, model, label, t, replicate, SUM(w * tp) AS tp, SUM(w * fp) AS fp, CAST(SUM(w * n) AS DOUBLE) AS n FROM b JOIN w USING (cluster_id) GROUP BY ALL), u AS (SELECT cohort, model, label, t, replicate, tp / n - fp / n * (t / (1 - t)) AS net_benefit FROM s),
 ub AS (SELECT cohort, model, label, t, quantile_cont(net_benefit, 0.025) AS lower, quantile_cont(net_benefit, 0.975) AS upper FROM u GROUP BY ALL)"""


def benefits(sums, *also):
    """cohort, model, label, t, replicate, also and net_benefit of replicates' sums at the thresholds."""
    each = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"tp_{i}").alias("tp"), F.col(f"fp_{i}").alias("fp")) for i, t in enumerate(AT)])
    rows = sums.select(*KEYS, "replicate", *also, (F.col("pos") + F.col("neg")).alias("n"), F.explode(each).alias("x")).select("*", "x.*").drop("x")
    return rows.withColumn("net_benefit", scalar.net_benefit(F.col("tp"), F.col("fp"), F.col("n"), F.col("t")))


@query("b14_utility_and_auroc", f"""WITH {WEIGHTS}, {AT_SQL}, {BENEFIT_BOOT}, {boot_sql("SELECT * FROM {PRED}", "cohort, model, label")}, ab AS (SELECT cohort, model, label, quantile_cont(auroc, 0.025) AS al, quantile_cont(auroc, 0.975) AS au FROM boot GROUP BY ALL)
SELECT cohort, model, label, t, round(al, 6) AS auroc_lower, round(au, 6) AS auroc_upper, round(lower, 6) AS lower, round(upper, 6) AS upper FROM ub JOIN ab USING (cohort, model, label)""")
def b14(spark, sf_dir):
    """Ranking and net benefit of the same draws."""
    rows, keys = cut(benefits(B.replicate_scan(predictions(spark, sf_dir), KEYS, AT, REPLICATES), "auroc")), [*KEYS, "t"]
    ranks = B.interval(rows, keys, "auroc").select(*keys, F.col("lower").alias("auroc_lower"), F.col("upper").alias("auroc_upper"))
    return rounded(ranks.join(B.interval(rows, keys, "net_benefit").select(*keys, "lower", "upper"), keys))


@query("j16_grid_with_intervals", f"""WITH {WEIGHTS}, {AT_SQL.replace("g AS", "at_g AS", 1)}, {BENEFIT_BOOT.replace("CROSS JOIN g ", "CROSS JOIN at_g ")}, {CURVE} SELECT c.cohort, c.model, c.label, c.t, round(c.net_benefit, 6) AS net_benefit, round(ub.lower, 6) AS lower, round(ub.upper, 6) AS upper
 FROM curve c LEFT JOIN ub ON ub.cohort = c.cohort AND ub.model = c.model AND ub.label = c.label AND round(ub.t * 100) = round(c.t * 100)""")
def j16(spark, sf_dir):
    """The decision curve, with intervals at three of its fifty thresholds and null elsewhere; an interval that the curve lacks fails."""
    rows = predictions(spark, sf_dir)
    # Both are as small as keys by thresholds, and the checks of their join read them several times.
    curve = cut(U.decision_curve(rows, KEYS).select(*KEYS, "t", "net_benefit"))
    bounds = cut(B.interval(benefits(B.threshold_replicates(rows, KEYS, AT, REPLICATES)), [*KEYS, "t"], "net_benefit").select(*KEYS, "t", "lower", "upper"))
    return rounded(U.attach(curve, bounds, "t", keys=KEYS))


CUTS = """held AS (SELECT model, label, p, SUM(y) AS pos FROM {PRED} WHERE cohort = 'F' AND fold = 9 GROUP BY ALL), hs AS (SELECT *, SUM(pos) OVER (PARTITION BY model, label ORDER BY p DESC ROWS UNBOUNDED PRECEDING) / nullif(CAST(SUM(pos) OVER (PARTITION BY model, label) AS DOUBLE), 0) AS share FROM held),
 cut AS (SELECT model, label, 'sensitivity_90' AS rule, coalesce(MAX(CASE WHEN share >= CAST(0.9 AS DOUBLE) THEN p END), 0) AS t FROM hs GROUP BY ALL UNION ALL SELECT DISTINCT model, label, 'half', CAST(0.5 AS DOUBLE) FROM held)"""


@query("q22_operating_points", f"""WITH {CUTS}, c AS (SELECT cohort, model, label, rule, MAX(t) AS t, CAST(COUNT(*) FILTER (WHERE p >= t AND y = 1) AS DOUBLE) AS tp, CAST(COUNT(*) FILTER (WHERE p >= t AND y = 0) AS DOUBLE) AS fp, CAST(COUNT(*) FILTER (WHERE p < t AND y = 0) AS DOUBLE) AS tn, CAST(COUNT(*) FILTER (WHERE p < t AND y = 1) AS DOUBLE) AS fn FROM {{PRED}} JOIN cut USING (model, label) GROUP BY ALL)
SELECT cohort, model, label, rule, round(t, 6) AS t, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS ppv, round((tp + fp) / (tp + fp + tn + fn), 6) AS flag_rate FROM c""")
def q22(spark, sf_dir):
    """Two sets of thresholds from the validation fold, met by all cohorts."""
    rows = predictions(spark, sf_dir)
    held = rows.where("cohort = 'F' and fold = 9")
    reach = D.sensitivity_floor(held, ["model", "label"], 0.9).select("model", "label", F.lit("sensitivity_90").alias("rule"), F.col("threshold").alias("t"))
    cuts = reach.union(held.select("model", "label", F.lit("half"), F.lit(0.5)).distinct())
    counts = D.confusion(rows.join(cuts, ["model", "label"]), [*KEYS, "rule", "t"], F.col("t"))
    return rounded(D.operating_ratios(counts).select(*KEYS, "rule", "t", "sensitivity", "specificity", "ppv", "flag_rate"))


# --- calibration


@query("e05_source_prevalence", """WITH o AS (SELECT label, fold, y FROM {PRED} WHERE cohort = 'F' AND model = 'size'), a AS (SELECT label, AVG(y) AS prevalence, COUNT(*) AS records FROM o WHERE fold <= 8 GROUP BY label)
SELECT label, round(prevalence, 6) AS prevalence, records FROM a""")
def e05(spark, sf_dir):
    """Training folds' prevalence; both models' rows must say the same, else this fails."""
    rows = predictions(spark, sf_dir).where("cohort = 'F' and fold <= 8")
    seen = lambda m: rows.where(F.col("model") == m).groupBy("label").agg(F.avg("y").alias("prevalence"), F.count("*").alias("records"))
    one, other = seen("size"), seen("discount")
    from ..operators.expect import nothing

    nothing(one.exceptAll(other), "prevalences differ")
    return rounded(one)


@query("e06_fold_confusion", f"""WITH {CUTS} SELECT model, label, rule, round(AVG(CASE WHEN y = 1 THEN CAST(p >= t AS INT) END), 6) AS tpr, round(AVG(CASE WHEN y = 0 THEN CAST(p >= t AS INT) END), 6) AS fpr FROM {{PRED}} JOIN cut USING (model, label) WHERE cohort = 'F' AND fold = 9 GROUP BY ALL""")
def e06(spark, sf_dir):
    held = predictions(spark, sf_dir).where("cohort = 'F' and fold = 9")
    reach = D.sensitivity_floor(held, ["model", "label"], 0.9).select("model", "label", F.lit("sensitivity_90").alias("rule"), F.col("threshold").alias("t"))
    cuts = reach.union(held.select("model", "label", F.lit("half"), F.lit(0.5)).distinct())
    flag = (F.col("p") >= F.col("t")).cast("double")
    rate = lambda v: F.avg(F.when(F.col("y") == v, flag))
    return rounded(held.join(cuts, ["model", "label"]).groupBy("model", "label", "rule").agg(rate(1).alias("tpr"), rate(0).alias("fpr")))


@query("a48_prevalence_error", """WITH s AS (SELECT model, label, AVG(CASE WHEN y = 1 THEN CAST(p >= CAST(0.6 AS DOUBLE) AS INT) END) AS tpr, AVG(CASE WHEN y = 0 THEN CAST(p >= CAST(0.6 AS DOUBLE) AS INT) END) AS fpr FROM {PRED} WHERE cohort = 'F' GROUP BY ALL), t AS (SELECT cohort, model, label, AVG(CAST(p >= CAST(0.6 AS DOUBLE) AS INT)) AS q, AVG(y) AS truth FROM {PRED} WHERE cohort <> 'F' GROUP BY ALL),
 e AS (SELECT cohort, model, ABS(LEAST(GREATEST((q - fpr) / (tpr - fpr), 0), 1) - truth) AS error FROM s JOIN t USING (model, label) WHERE tpr - fpr <> 0)
SELECT cohort, model, round(AVG(error), 6) AS mean_error, round(median(error), 6) AS median_error, round(MAX(error), 6) AS most_error FROM e GROUP BY ALL""")
def a48(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("flag", (F.col("p") >= 0.6).cast("double"))
    source = rows.where("cohort = 'F'").groupBy("model", "label").agg(F.avg(F.when(F.col("y") == 1, F.col("flag"))).alias("tpr"), F.avg(F.when(F.col("y") == 0, F.col("flag"))).alias("fpr"))
    target = rows.where("cohort <> 'F'").groupBy(*KEYS).agg(F.avg("flag").alias("q"), F.avg("y").alias("truth"))
    guess = target.join(source, ["model", "label"]).withColumn("error", F.abs(scalar.bbse_prevalence(F.col("q"), F.col("tpr"), F.col("fpr")) - F.col("truth"))).where("error is not null")
    return rounded(guess.groupBy(*UNIT).agg(F.avg("error").alias("mean_error"), F.median("error").alias("median_error"), F.max("error").alias("most_error")))


FRACTIONS = (0.1, 0.5, 1.0)


@query("q10_ece_bias", f"""WITH fr AS ({" UNION ALL ".join(f"SELECT CAST({f} AS DOUBLE) AS fraction" for f in FRACTIONS)}), r AS (SELECT cohort, record_id, row_number() OVER (PARTITION BY cohort ORDER BY md5(record_id || '#' || 3), record_id) AS k, COUNT(*) OVER (PARTITION BY cohort) AS n FROM {{ORDERS}}), kept AS (SELECT cohort, record_id, fraction FROM r CROSS JOIN fr WHERE k <= round_even(n * fraction, 0)),
 rows_ AS (SELECT p.*, fraction FROM {{PRED}} p JOIN kept USING (cohort, record_id)), {ece_sql("SELECT * FROM rows_", "cohort, model, fraction", "e")}, {WEIGHTS}, t AS (SELECT cluster_id, cohort, model, fraction, LEAST(CAST(FLOOR(p * 15) AS INT), 14) AS bin, COUNT(*) AS n, SUM(y) AS sy, SUM(p) AS sp FROM rows_ GROUP BY ALL),
 ws AS (SELECT cohort, model, fraction, replicate, bin, SUM(w * n) AS n, SUM(w * sy) AS sy, SUM(w * sp) AS sp FROM t JOIN w USING (cluster_id) GROUP BY ALL), eb AS (SELECT cohort, model, fraction, replicate, SUM(ABS(sy - sp)) / SUM(n) AS ece FROM ws WHERE n > 0 GROUP BY ALL)
SELECT cohort, model, fraction, round(MAX(e.ece), 6) AS point, round(AVG(eb.ece), 6) AS resampled, round(AVG(eb.ece) - MAX(e.ece), 6) AS bias, round(AVG(CASE WHEN eb.ece > e.ece THEN 1 ELSE 0 END), 6) AS share_above FROM eb JOIN e USING (cohort, model, fraction) GROUP BY ALL""")
def q10(spark, sf_dir):
    """How far resampling lifts the calibration error, at several fractions of the records."""
    keys = [*UNIT, "fraction"]
    sample = None
    for f in FRACTIONS:
        own = B.subsample(orders(spark, sf_dir), ["cohort"], "record_id", f, F.lit(3)).select("cohort", "record_id", F.lit(f).alias("fraction"))
        sample = own if sample is None else sample.union(own)
    rows = predictions(spark, sf_dir).join(sample, ["cohort", "record_id"])
    sums = B.replicate_sums(C.bin_rows(rows, ["cluster_id", *keys]), [*keys, "bin"], ["n", "sum_y", "sum_p", "sum_sq"], REPLICATES)
    reps = C.from_totals(sums.where("n > 0"), [*keys, "replicate"]).select(*keys, F.col("ece").alias("again"))
    both = reps.join(C.calibration(rows, keys).select(*keys, F.col("ece").alias("point")), keys)
    return rounded(both.groupBy(*keys).agg(
        F.max("point").alias("point"), F.avg("again").alias("resampled"), (F.avg("again") - F.max("point")).alias("bias"),
        F.avg((F.col("again") > F.col("point")).cast("double")).alias("share_above"),
    ))


@query("b22_published_check", f"""WITH {BOOT_AUC}, m AS (SELECT cohort, label, model, replicate, auroc FROM boot), i AS (SELECT cohort, model, label, quantile_cont(auroc, 0.025) AS lower FROM m GROUP BY ALL), pub AS (SELECT cohort, model, label, quantile_cont(auroc, 0.025) AS published FROM m WHERE replicate < 100 GROUP BY ALL)
SELECT cohort, model, label, round(lower, 6) AS lower, round(published, 6) AS published, ABS(round(lower, 6) - round(published, 6)) <= CAST(0.002 AS DOUBLE) AS within FROM i JOIN pub USING (cohort, model, label)""")
def b22(spark, sf_dir):
    """Bounds of all replicates against those published from the first half of them: some differ by more than the tolerance."""
    reps = cut(boot(spark, sf_dir))
    own = rounded(B.interval(reps, KEYS, "auroc").select(*KEYS, "lower"))
    published = rounded(B.interval(reps.where("replicate < 100"), KEYS, "auroc").select(*KEYS, F.col("lower").alias("published")))
    return B.within(own, published, KEYS, "lower", "published", 0.002).select(*KEYS, "lower", "published", "within")


# --- records, filters and shapes


@query("p08_cohort_records", "SELECT cohort, COUNT(*) AS records FROM {ORDERS} WHERE cohort <> 'F' OR fold = 10 GROUP BY cohort")
def p08(spark, sf_dir):
    """The held-out fold of the internal cohort, all records of the others."""
    return orders(spark, sf_dir).where(L.cohort_records("F", 10)).groupBy("cohort").agg(F.count("*").alias("records"))


@query("p15_oriented_scores", """WITH s AS (SELECT cohort, model, label, y, CASE WHEN label = 'urgent' THEN -p ELSE p END AS p FROM {PRED} WHERE record_id % 11 <> 0), """ + auc_sql("SELECT * FROM s", "cohort, model, label", "a") + " SELECT cohort, model, label, round(auroc, 6) AS auroc FROM a")
def p15(spark, sf_dir):
    """Undefined scores leave before ranking; a score whose high values speak against the label is turned round."""
    rows = predictions(spark, sf_dir).withColumn("p", F.when(F.col("record_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("p")))
    turned = D.oriented(rows, F.when(F.col("label") == "urgent", -1).otherwise(1))
    return rounded(D.auroc(turned, KEYS).select(*KEYS, "auroc"))


NAMES = {"F": "Internal", "O": "First external"}


@query("p18_display_names", "SELECT CASE cohort WHEN 'F' THEN 'Internal' WHEN 'O' THEN 'First external' ELSE cohort END AS name, COUNT(*) AS records FROM {ORDERS} GROUP BY ALL")
def p18(spark, sf_dir):
    return orders(spark, sf_dir).groupBy(scalar.display_name(F.col("cohort"), NAMES).alias("name")).agg(F.count("*").alias("records"))


@query("k02_position_after_sort", "SELECT cohort, record_id, row_number() OVER (PARTITION BY cohort ORDER BY record_id) - 1 AS position FROM {ORDERS} QUALIFY position % 10 = 3")
def k02(spark, sf_dir):
    """Ids in order, positions from 0, and a slice by position."""
    return B.cluster_places(orders(spark, sf_dir).select("cohort", "record_id"), "cohort", "record_id").withColumnRenamed("place", "position").where("position % 10 = 3")


@query("f26_flattened_runs", """WITH r AS (SELECT event_type AS model, CAST(user_id % 3 AS INT) AS seed, COUNT(*) AS n FROM events GROUP BY ALL) SELECT concat(model, '-seed-', seed) AS run, sha256(concat(model, ':', seed, ':', n)) AS digest FROM r""")
def f26(spark, sf_dir):
    """A manifest nested by model and seed, to one row a run with its name."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 3).cast("int").alias("seed")).agg(F.count("*").alias("n"))
    digest = F.sha2(F.concat_ws(":", "model", F.col("seed").cast("string"), F.col("n").cast("string")), 256)
    nested = e.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("seed", digest.alias("digest")))).alias("digests"))
    return L.flat_runs(nested)


@query("a43_mean_by_class", """SELECT CASE WHEN label IN ('returned', 'urgent') THEN 'status' ELSE 'size' END AS finding_class, model, round(AVG(y), 6) AS rate, round(AVG(p), 6) AS mean_p FROM {PRED} GROUP BY ALL""")
def a43(spark, sf_dir):
    """Labels' means by the class of finding they belong to."""
    kind = F.when(F.col("label").isin("returned", "urgent"), "status").otherwise("size")
    return rounded(predictions(spark, sf_dir).groupBy(kind.alias("finding_class"), "model").agg(F.avg("y").alias("rate"), F.avg("p").alias("mean_p")))


@query("a44_failure_rates", "SELECT event_type, COUNT(*) AS records, COUNT(*) FILTER (WHERE value < 1) AS failed, round(AVG(CASE WHEN value < 1 THEN 1 ELSE 0 END), 6) AS rate FROM events GROUP BY event_type")
def a44(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(L.failure_rates(e.withColumn("failed", F.col("value") < 1), ["event_type"], "failed"))


@query("a45_rate_check", """WITH v AS (SELECT event_type, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) SELECT event_type, COUNT(v) AS used, round(AVG(CASE WHEN v IS NOT NULL THEN CAST(v > 50 AS INT) END), 6) AS defining_share, round(median(v), 6) AS median FROM v GROUP BY event_type""")
def a45(spark, sf_dir):
    """The share on the side that defines a finding, and the median, both over defined values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return rounded(L.rate_check(e, ["event_type"], "v", lambda v: v > 50))
