"""Queries on provenance, cached inference, incremental runs and figure tables."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import expit
from ..operators import discrimination as D
from ..operators import expect
from ..operators import inference as I
from ..operators import provenance as P
from ..operators.lineage import cut, shared_folder
from ..sources import incremental
from ..sources.adapters import orders, predictions
from .composites import auc_sql
from .registry import query, rounded


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(*parts) -> F.Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts]), 256)


# --- provenance: a customer's orders stand for a history of commits


def history(spark, sf_dir) -> DataFrame:
    earlier = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child"), earlier.alias("parent"))


@query("i02_ancestry", """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders), e AS (SELECT c, MIN(k) AS lo, MAX(k) AS hi FROM o GROUP BY c), p AS (SELECT lo AS ancestor, hi AS descendant FROM e UNION SELECT hi, lo FROM e UNION SELECT a.hi, b.lo FROM e a JOIN e b ON b.c = a.c + 1)
SELECT ancestor, descendant, a.c = d.c AND ancestor <= descendant AS holds FROM p JOIN o a ON a.k = ancestor JOIN o d ON d.k = descendant""")
def i02_ancestry(spark, sf_dir):
    """First and last commits of every history both ways, and commits of two histories."""
    ends = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    after = ends.select((F.col("c") - 1).alias("c"), F.col("lo").alias("next"))
    pair = lambda d, a, b: d.select(F.col(a).alias("ancestor"), F.col(b).alias("descendant"))
    pairs = pair(ends, "lo", "hi").union(pair(ends, "hi", "lo")).union(pair(ends.join(after, "c"), "hi", "next")).distinct()
    return P.ancestry(pairs, history(spark, sf_dir))


@query("i02_evaluation_guard", """WITH o AS (SELECT o_custkey AS c, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders GROUP BY 1), s AS (SELECT c, CASE WHEN c % 11 = 0 THEN hi + 1000000007 WHEN c % 7 = 0 THEN hi ELSE lo END AS reg, CASE WHEN c % 7 = 0 THEN lo ELSE hi END AS cho FROM o)
SELECT c AS seal_id, concat_ws('|', CASE WHEN c % 11 = 0 THEN 'registration_known' END, CASE WHEN c % 17 = 0 THEN 'worktree_as_sealed' END, CASE WHEN c % 5 = 0 OR c % 13 = 0 THEN 'commit_as_sealed' END, CASE WHEN reg > cho THEN 'descends_from_registration' END,
 CASE WHEN c % 29 = 0 THEN 'names_registration' END, CASE WHEN c % 23 = 0 THEN 'names_study' END, CASE WHEN c % 19 = 0 THEN 'not_yet_run' END) AS broken FROM s""")
def i02_guard(spark, sf_dir):
    """A seal a customer, with planted faults of every kind; every broken rule is told."""
    c = F.col("c")
    ends = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    registration = F.when(c % 11 == 0, F.col("hi") + 1_000_000_007).when(c % 7 == 0, F.col("hi")).otherwise(F.col("lo"))
    seals = ends.select(
        c.alias("seal_id"), registration.alias("registration"), F.when(c % 7 == 0, F.col("lo")).otherwise(F.col("hi")).alias("choices"), F.lit("choices.json").alias("path"),
        sha(c).alias("sealed_digest"), F.when(c % 17 == 0, sha("other", c)).otherwise(sha(c)).alias("worktree_digest"), (c % 19 == 0).alias("completed"),
        F.lit("study").alias("registration_study"), F.when(c % 23 == 0, "another").otherwise("study").alias("study"), F.when(c % 29 == 0, registration - 1).otherwise(registration).alias("choices_registration"),
    )
    blobs = seals.where("seal_id % 13 <> 0").select(F.col("choices").alias("commit"), "path", F.when(F.col("seal_id") % 5 == 0, sha("changed", F.col("seal_id"))).otherwise(F.col("sealed_digest")).alias("digest"))
    return P.evaluation_guard(seals, blobs, history(spark, sf_dir)).select("seal_id", F.array_join("broken", "|").alias("broken"))


#: Planted faults by rule: the pass breaks it where its order's key is divisible by this.
FAULTS = {"run_there": 31, "run_complete": 29, "all_epochs": 23, "nothing_protected": 37, "not_limited": 41, "checkpoint_there": 43, "checkpoint_model": 47, "checkpoint_seed": 53, "checkpoint_epoch": 59}


def chain_sql() -> str:
    run = ("run_there", "run_complete", "all_epochs", "nothing_protected", "not_limited")
    fault = lambda r: f"k % {FAULTS[r]} = 0" + (" OR k % 31 = 0" if r in run or r == "checkpoint_epoch" else "") + (" OR k % 43 = 0" if r.startswith("checkpoint") else "")
    cohort = {"receipt_complete": "cohort = 'P'", "receipt_choices": "cohort = 'O'", "records_bound": "false", "targets_bound": "cohort = 'F'", "record_count": "cohort = 'P'"}
    rules = [f"SELECT cohort, '{r}' AS rule, {fault(r)} AS bad FROM p" for r in FAULTS] + [f"SELECT cohort, '{r}', {c} FROM p" for r, c in cohort.items()]
    return f"WITH p AS (SELECT o_orderstatus AS cohort, o_orderkey AS k FROM orders) SELECT cohort, rule, COUNT(*) AS passes FROM ({' UNION ALL '.join(rules)}) WHERE bad GROUP BY ALL"


@query("i12_provenance_chain", chain_sql())
def i12(spark, sf_dir):
    """Scored passes with planted faults in every link: how many break each rule, by cohort."""
    k, o = F.col("k"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("cohort"), F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string")).alias("model"))
    bad = lambda rule: k % FAULTS[rule] == 0
    passes = o.select("cohort", "model", k.alias("seed"), sha(k).alias("checkpoint"))
    best = (k % 50 + 1).cast("int")
    runs = o.where(~bad("run_there")).select(
        "model", k.alias("seed"), F.when(bad("run_complete"), "stopped").otherwise("complete").alias("run_status"), F.when(bad("all_epochs"), 49).otherwise(50).alias("completed_epochs"),
        best.alias("best_epoch"), bad("nothing_protected").alias("protected_accessed"), bad("not_limited").alias("limited"),
    )
    checkpoints = o.where(~bad("checkpoint_there")).select(
        sha(k).alias("checkpoint"), F.when(bad("checkpoint_model"), "other").otherwise(F.col("model")).alias("checkpoint_model"), F.when(bad("checkpoint_seed"), k + 1).otherwise(k).alias("checkpoint_seed"),
        F.when(bad("checkpoint_epoch"), best).otherwise(best - 1).alias("checkpoint_epoch"),
    )
    digests = o.groupBy("cohort").agg(F.count("*").alias("n")).withColumn("own", sha("records", F.col("cohort")))
    receipts = digests.where("cohort <> 'P'").select(
        "cohort", F.lit("complete").alias("receipt_status"), F.when(F.col("cohort") == "O", "later").otherwise("sealed").alias("receipt_choices"), F.col("own").alias("receipt_records_digest"),
        F.when(F.col("cohort") == "F", sha("other")).otherwise(sha("targets", F.col("cohort"))).alias("receipt_targets_digest"), F.col("n").alias("receipt_records"),
    ).unionByName(digests.where("cohort = 'P'").select(
        "cohort", F.lit("started").alias("receipt_status"), F.lit("sealed").alias("receipt_choices"), F.col("own").alias("receipt_records_digest"), sha("targets", F.col("cohort")).alias("receipt_targets_digest"), (F.col("n") - 1).alias("receipt_records")
    ))
    bound = digests.select("cohort", F.lit("sealed").alias("sealed_choices"), F.col("own").alias("bound_records_digest"), sha("targets", F.col("cohort")).alias("bound_targets_digest"), F.col("n").alias("bound_records"))
    return P.broken_counts(P.provenance_chain(passes, runs, checkpoints, receipts, bound, 50), ["cohort"])


# --- inference with receipts

SEEDS = {"narrow": (0.8, (17, 29, 43)), "wide": (1.4, (17, 29))}
TEMPERATURES = {"narrow": 1.5, "wide": 0.75}


def seed_score(weight: float, seed: int, records: DataFrame) -> DataFrame:
    z = (F.col("p_size") - 0.5) * F.lit(weight * 4) + (F.col("p_discount") - 0.5) * F.lit(seed / 50)
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"y_{label}").alias("y"), expit(z + shift).alias("p")) for label, shift in (("returned", 0.3), ("large", -0.4))])
    return records.select("record_id", F.explode(each).alias("s")).select("record_id", "s.*")


def seed_sql() -> str:
    rows = [
        f"SELECT '{model}' AS model, record_id, '{label}' AS label, y_{label} AS y, CAST(1 / (1 + exp(-((p_size - CAST(0.5 AS DOUBLE)) * CAST({w * 4} AS DOUBLE) + (p_discount - CAST(0.5 AS DOUBLE)) * CAST({s / 50} AS DOUBLE) + CAST({shift} AS DOUBLE)))) AS REAL) AS p FROM o"
        for model, (w, seeds) in SEEDS.items() for s in seeds for label, shift in (("returned", 0.3), ("large", -0.4))
    ]
    t = " ".join(f"WHEN '{m}' THEN CAST({v} AS DOUBLE)" for m, v in TEMPERATURES.items())
    return f"""WITH o AS (SELECT * FROM {{ORDERS}} WHERE cohort = 'O'), s AS ({" UNION ALL ".join(rows)}), m AS (SELECT model, record_id, label, y, COUNT(*) AS seeds, AVG(CAST(p AS DOUBLE)) AS mean FROM s GROUP BY ALL)
SELECT model, record_id, label, y, seeds, round(CAST(CAST(mean AS REAL) AS DOUBLE), 5) AS p, round(CAST(CAST(1 / (1 + exp(-(ln(mean / (1 - mean)) / CASE model {t} END))) AS REAL) AS DOUBLE), 5) AS calibrated FROM m"""


@query("e15_cached_inference", seed_sql())
def e15(spark, sf_dir):
    """A cohort by five passes with receipts, interrupted after three of them and gone on with; the ensembles come through receipts alone."""
    # Every pass, and the checks of what it wrote, read the records: written once, they don't shuffle the lines behind them again.
    records = cut(orders(spark, sf_dir).where("cohort = 'O'").select("record_id", "p_size", "p_discount", "y_returned", "y_large"))
    long = seed_score(1.0, 1, records).select("record_id", "label", "y")
    passes = [I.Pass(m, s, f"{m}-{s}", partial(lambda w, s, _: seed_score(w, s, records), w, s)) for m, (w, seeds) in SEEDS.items() for s in seeds]
    root = f"{shared_folder(spark)}/inference-{uuid.uuid4().hex}"
    first = I.score_cohort(spark, long, passes[:3], root, "O", "choices")
    rest = I.score_cohort(spark, long, passes, root, "O", "choices")
    if (first, rest) != (3, len(passes) - 3):
        raise expect.Unmet(f"{first} and {rest} passes were scored")
    out = I.ensembles(I.cohort_scores(spark, passes, root, "O", "choices"), TEMPERATURES)
    return out.select("model", "record_id", "label", "y", "seeds", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("p", "calibrated")])


# --- incremental runs


@query("s27_source_states", """WITH m AS (SELECT 'part-' || p_partkey AS name, p_partkey AS k FROM part) SELECT name, CASE WHEN k % 3 = 0 THEN 'sealed' ELSE 'observed' END AS binding,
 CASE WHEN k % 7 = 0 THEN 'missing' WHEN k % 5 <> 0 THEN 'verified' WHEN k % 3 = 0 THEN 'failed' ELSE 'changed' END AS state FROM m""")
def s27(spark, sf_dir):
    """Sources against sealed and observed digests: what is verified is skipped, what differs fails or is told."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), k.cast("string")).alias("name"), k)
    manifest = p.select("name", F.when(k % 3 == 0, sha(k)).alias("sealed"), sha(k).alias("observed"))
    found = p.where(k % 7 != 0).select("name", F.when(k % 5 == 0, sha("new", k)).otherwise(sha(k)).alias("digest"))
    return incremental.source_states(manifest, found).select("name", "binding", "state")


@query("i16_unfinished_runs", "SELECT concat('m', o_custkey % 5) AS model, o_orderkey AS seed FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 9 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def i16(spark, sf_dir):
    """Runs that a second start still has to make: missing, stopped, short or limited ones."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    wanted = o.select(F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string")).alias("model"), k.alias("seed"))
    runs = wanted.where("seed % 4 <> 0").select(
        "model", "seed", F.when(F.col("seed") % 9 == 0, "stopped").otherwise("complete").alias("status"), F.when(F.col("seed") % 5 == 0, 20).otherwise(50).alias("completed_epochs"),
        F.lit(50).alias("maximum_epochs"), (F.col("seed") % 7 == 0).alias("limited"),
    )
    return incremental.unfinished(wanted, runs, 50)


# --- figure tables

SUBTOTALS = "SELECT coalesce(cohort, 'all') AS cohort, model, coalesce(label, 'all') AS label, p, SUM(y) AS y, SUM(1 - y) AS n FROM {PRED} GROUP BY GROUPING SETS ((cohort, model, label, p), (cohort, model, p), (model, label, p), (model, p))"


def heatmap_sql() -> str:
    scan = f"c AS ({SUBTOTALS}), s AS (SELECT *, SUM(n) OVER (PARTITION BY cohort, model, label ORDER BY p ROWS UNBOUNDED PRECEDING) - n AS below FROM c)"
    a = "a AS (SELECT cohort, model, label, CASE WHEN SUM(y) > 0 AND SUM(n) > 0 THEN SUM(y * (below + n * CAST(0.5 AS DOUBLE))) / (SUM(y) * SUM(n)) END AS auroc FROM s GROUP BY ALL)"
    cells = ", ".join(f"round(MAX(auroc) FILTER (WHERE cohort = '{c}'), 6) AS {c.lower()}_auroc" for c in ("F", "O", "P", "all"))
    return f"WITH {scan}, {a} SELECT model, label, {cells}, round(MAX(auroc) FILTER (WHERE cohort = 'F') - LEAST(MAX(auroc) FILTER (WHERE cohort = 'O'), MAX(auroc) FILTER (WHERE cohort = 'P')), 6) AS drop FROM a GROUP BY ALL"


@query("r09_heatmap", heatmap_sql())
def r09(spark, sf_dir):
    """A heatmap with margins: a row a model and label and one for all labels, a column a cohort and one for all, the drop beside them."""
    rows = predictions(spark, sf_dir).select("cohort", "model", "label", "p", "y")
    sets = [["cohort", "model", "label", "p"], ["cohort", "model", "p"], ["model", "label", "p"], ["model", "p"]]
    counts = rows.groupingSets(sets, "cohort", "model", "label", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    keys = ["cohort", "model", "label"]
    counts = counts.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("cohort", "label")})
    wide = D.auroc_of_counts(counts, keys).groupBy("model", "label").pivot("cohort", ["F", "O", "P", "all"]).agg(F.max("auroc"))
    cells = [F.col(c).alias(f"{c.lower()}_auroc") for c in ("F", "O", "P", "all")]
    return rounded(wide.select("model", "label", *cells, (F.col("F") - F.least("O", "P")).alias("drop")))


@query("r09_transfer", f"""WITH {auc_sql("SELECT * FROM {PRED} WHERE label <> 'never'", "cohort, model, label", "a")}, m AS (SELECT model, cohort, AVG(auroc) AS macro FROM a GROUP BY ALL)
SELECT x.model, x.cohort, round(i.macro, 6) AS inside, round(x.macro, 6) AS outside, round(x.macro - i.macro, 6) AS change, rank() OVER (PARTITION BY x.cohort ORDER BY round(x.macro, 9) DESC) AS place FROM m x JOIN m i ON i.model = x.model AND i.cohort = 'F' WHERE x.cohort <> 'F'""")
def r09_transfer(spark, sf_dir):
    """What each model keeps outside: its mean inside and outside, the change, and its place among the models there."""
    macro = D.macro(D.auroc(predictions(spark, sf_dir).where("label <> 'never'"), ["cohort", "model", "label"]), ["model", "cohort"], "auroc")
    inside = macro.where("cohort = 'F'").select("model", F.col("macro_auroc").alias("inside"))
    rows = macro.where("cohort <> 'F'").join(inside, "model").withColumn("change", F.col("macro_auroc") - F.col("inside"))
    place = F.rank().over(W.partitionBy("cohort").orderBy(F.round("macro_auroc", 9).desc())).cast("long")
    return rounded(rows.select("model", "cohort", "inside", F.col("macro_auroc").alias("outside"), "change", place.alias("place")))


@query("j17_curve_lookup", """WITH c AS (SELECT cohort, model, CAST(fold AS DOUBLE) / 10 AS fraction, COUNT(*) AS n, AVG(p) AS mean_p FROM {PRED} GROUP BY ALL) SELECT cohort, model, fraction, n, round(mean_p, 6) AS mean_p FROM c WHERE round(fraction, 6) IN (0.2, 0.5, 1.0)""")
def j17(spark, sf_dir):
    """Points of a curve at asked fractions; a fraction that the curve lacks fails."""
    curve = predictions(spark, sf_dir).groupBy("cohort", "model", (F.col("fold").cast("double") / 10).alias("fraction")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"))
    return rounded(D.at_points(curve, ["cohort", "model"], "fraction", [0.2, 0.5, 1.0]), "mean_p")


@query("p19_development_rows", "SELECT cohort, record_id FROM {ORDERS} ORDER BY cohort, record_id LIMIT 25")
def p19(spark, sf_dir):
    """The first rows in order, for development; the limit is the feature."""
    return orders(spark, sf_dir).select("cohort", "record_id").orderBy("cohort", "record_id").limit(25)
