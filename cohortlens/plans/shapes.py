"""Queries on filters, joins with expectations, text and map expressions, orders, and figure tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse, scalar
from ..operators import beats
from ..operators import bootstrap as B
from ..operators import calibration as C
from ..operators import discrimination as D
from ..operators import expect as E
from ..operators import labels as L
from ..operators import provenance as P
from ..operators import signals
from ..operators.lineage import cut
from ..sources import files
from ..sources.adapters import orders, predictions
from .composites import PEOPLE_ROWS, auc_sql, ece_sql, subgroups
from .metrics import BINS
from .operations import sha, table
from .records import lead_signals
from .registry import query, rounded
from .studies import BOOT_AUC, KEYS, REPLICATES, SETS, boot, day_sets

UNIT = ["cohort", "model"]


# --- filters and joins


@query("p03_whole_code_exclusion", f"WITH {SETS} SELECT user_id, day, codes FROM sets WHERE NOT list_has_any(string_split(codes, '|'), ['logout', 'sign'])")
def p03(spark, sf_dir):
    """Days without a code; 'sign' is part of 'signup' and no code of its own, so it takes nothing away."""
    return L.without_codes(day_sets(spark, sf_dir), "codes", ["logout", "sign"])


@query("p20_row_slice", "SELECT cohort, position, record_id FROM (SELECT cohort, record_id, row_number() OVER (PARTITION BY cohort ORDER BY record_id) - 1 AS position FROM {ORDERS}) JOIN (SELECT DISTINCT CAST(c_nationkey * 7 AS BIGINT) AS position FROM customer) USING (position)")
def p20(spark, sf_dir):
    """Records gathered by a table of positions in each cohort's order."""
    asked = table(spark, sf_dir, "customer").select((F.col("c_nationkey") * 7).cast("long").alias("place")).distinct()
    placed = B.cluster_places(orders(spark, sf_dir).select("cohort", "record_id"), "cohort", "record_id")
    return placed.join(asked, "place").select("cohort", F.col("place").alias("position"), "record_id")


@query("j02_asserted_inner", "SELECT o_orderkey, o_custkey, lines FROM orders JOIN (SELECT l_orderkey, COUNT(*) AS lines FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderkey % 3 <> 0")
def j02(spark, sf_dir):
    """An inner join of unique keys, with the number of rows asserted."""
    left = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select("o_orderkey", "o_custkey")
    right = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    both = E.one_to_one(left, right, ["o_orderkey"], "inner", complete=False)
    return E.row_count(both, left.join(right, "o_orderkey", "left_semi").count())


@query("j03_stem_join", """SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 9 <> 0 THEN 'g' || (o_orderkey % 7) || '/HR' || lpad(CAST(o_orderkey + 5 AS VARCHAR), 9, '0') || '.mat' END AS path, CASE WHEN o_orderkey % 9 <> 0 THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS digest, o_orderkey % 9 = 0 AS missing FROM orders""")
def j03(spark, sf_dir):
    """Records find their matrix by the stem of the file that their header names, which is not their id."""
    k = F.col("o_orderkey")
    file = F.concat(parse.record_name(k + 5, "HR", 9), F.lit(".mat"))
    o = table(spark, sf_dir, "orders").select(k)
    lines = o.where(k % 9 != 0).select(F.concat(sha(k), F.lit("  ./g"), (k % 7).cast("string"), F.lit("/"), file).alias("line"))
    index = files.matrix_index(lines.select(parse.checksum_line(F.col("line")).alias("c")).select("c.*"))
    jobs = files.plan_jobs(o.select(k.alias("record_id"), file.alias("signal_file")), index, "record_id")
    return jobs.select("record_id", "job.path", "job.digest", "missing")


LABELS, COHORTS, LEVELS = ["large", "never", "returned", "urgent"], ["F", "O", "P", "X"], ["female", "male", "unknown"]


@query("j07_label_expansion", f"""WITH v AS (SELECT unnest({LABELS}) AS label), c AS (SELECT unnest({COHORTS}) AS cohort), l AS (SELECT unnest({LEVELS}) AS level), n AS (SELECT label, cohort, CASE WHEN cluster_id % 2 = 0 THEN 'male' ELSE 'female' END AS level, COUNT(*) AS rows, SUM(y) AS pos, SUM(1 - y) AS neg FROM {{PRED}} WHERE model = 'size' GROUP BY ALL)
SELECT label, cohort, level, coalesce(rows, 0) AS rows, CAST(coalesce(pos, 0) AS BIGINT) AS pos, CAST(coalesce(neg, 0) AS BIGINT) AS neg FROM v CROSS JOIN c CROSS JOIN l LEFT JOIN n USING (label, cohort, level)""")
def j07(spark, sf_dir):
    """Counts of every label, cohort and level, those without rows included."""
    rows = predictions(spark, sf_dir).where("model = 'size'").withColumn("level", scalar.sex_name(F.col("cluster_id") % 2))
    return L.expansion(rows, {"label": LABELS, "cohort": COHORTS, "level": LEVELS})


@query("a23_value_counts", """WITH s AS (SELECT event_type AS value, COUNT(*) AS seen FROM events GROUP BY 1), x AS (SELECT event_type AS value, COUNT(*) + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS expected FROM events WHERE event_type <> 'view' GROUP BY 1 UNION ALL SELECT 'never', 3)
SELECT value, coalesce(seen, 0) AS seen, coalesce(expected, 0) AS expected, coalesce(seen, 0) = coalesce(expected, 0) AS fits FROM s FULL JOIN x USING (value)""")
def a23(spark, sf_dir):
    """Counts of values against expected ones, with one off by one, one not expected and one not seen."""
    e = table(spark, sf_dir, "events")
    expected = e.where("event_type <> 'view'").groupBy(F.col("event_type").alias("value")).agg((F.count("*") + F.max((F.col("event_type") == "click").cast("long"))).alias("expected"))
    return E.value_counts(e, "event_type", expected.union(spark.range(1).select(F.lit("never"), F.lit(3).cast("long"))))


# --- text, numbers and maps


@query("f05_text_parts", r"""SELECT o_orderkey, trim(raw) AS trimmed, lower(raw) AS lowered, upper(raw) AS raised, regexp_extract('in/' || o_orderkey || '.v1.' || lower(trim(raw)), '([^/]*?)(?:\.[^./]*)?$', 1) AS stem FROM (SELECT o_orderkey, '  ' || o_orderpriority || ' ' AS raw FROM orders)""")
def f05(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("raw"))
    path = F.concat(F.lit("in/"), F.col("o_orderkey").cast("string"), F.lit(".v1."), F.lower(F.trim("raw")))
    return o.select("o_orderkey", F.trim("raw").alias("trimmed"), F.lower("raw").alias("lowered"), F.upper("raw").alias("raised"), parse.stem(path).alias("stem"))


@query("f08_float32_temperature", """WITH q AS (SELECT cohort, record_id, model, LEAST(GREATEST(CAST(CAST(p AS REAL) AS DOUBLE), 1e-7), 1 - 1e-7) AS q FROM {PRED} WHERE label = 'large') SELECT cohort, record_id, model, round(CAST(CAST(1 / (1 + exp(-(ln(q / (1 - q)) / CAST(1.7 AS DOUBLE)))) AS REAL) AS DOUBLE), 5) AS p FROM q""")
def f08(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("label = 'large'")
    return rows.select("cohort", "record_id", "model", F.round(scalar.temperature_scaled_float32(F.col("p"), 1.7), 5).alias("p"))


@query("f11_nll_and_gradient", """WITH q AS (SELECT cohort, model, label, y, LEAST(GREATEST(p, 1e-7), 1 - 1e-7) AS q FROM {PRED}), z AS (SELECT cohort, model, label, y, 3 * ln(q / (1 - q)) AS z FROM q)
SELECT cohort, model, label, round(AVG(GREATEST(z, 0) + ln(1 + exp(-ABS(z))) - y * z), 6) AS nll, round(AVG(1 / (1 + exp(-z)) - y), 6) AS gradient FROM z GROUP BY ALL""")
def f11(spark, sf_dir):
    """Mean loss and its slope at three times the logits, where a plain logarithm would overflow."""
    rows = predictions(spark, sf_dir).withColumn("z", scalar.logit(F.col("p")) * 3)
    return rounded(rows.groupBy(*KEYS).agg(F.avg(scalar.stable_nll(F.col("y"), F.col("z"))).alias("nll"), F.avg(scalar.nll_gradient(F.col("y"), F.col("z"))).alias("gradient")))


@query("f25_label_maps", """WITH c AS (SELECT cohort, model, label, CAST(SUM(y) AS BIGINT) AS pos FROM {PRED} GROUP BY ALL) SELECT cohort, model, '{' || string_agg('"' || label || '":' || pos, ',' ORDER BY label) || '}' AS by_label FROM c GROUP BY ALL""")
def f25(spark, sf_dir):
    return L.label_map(predictions(spark, sf_dir), UNIT, "label", F.sum("y").cast("long")).select(*UNIT, F.to_json("by_label").alias("by_label"))


@query("u05_ordered_distinct", """WITH f AS (SELECT user_id, event_type, MIN(struct_pack(ts := ts, e := event_id)) AS place FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, '|' ORDER BY place) AS codes FROM f GROUP BY user_id""")
def u05(spark, sf_dir):
    """A user's codes, each once, in the order in which they first came."""
    found = L.ordered_distinct(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"])
    return found.select("user_id", parse.flat(F.col("values")).alias("codes"))


@query("w06_moving_average", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings) SELECT vec_id, round((2 * x[1] + x[2]) / 3, 6) + 0 AS first_v, round((x[10] + x[11] + x[12]) / 3, 6) + 0 AS mid_v, round((x[63] + 2 * x[64]) / 3, 6) + 0 AS last_v FROM e""")
def w06(spark, sf_dir):
    """A centred mean of three with mirrored ends."""
    x = F.flatten(F.transform("signal", lambda l: l.cast("array<double>")))
    rows = lead_signals(spark, sf_dir).select("vec_id", beats.envelope(x, 100.0).alias("x"))
    return rounded(rows.select("vec_id", *[F.get("x", F.lit(i)).alias(n) for n, i in (("first_v", 0), ("mid_v", 10), ("last_v", 63))]))


# --- orders and figure tables

ORDER = {"cohort": ["P", "F"], "level": ["65_plus", "male", "under_40", "female"]}


@query("k05_custom_order", f"""WITH {PEOPLE_ROWS}, m AS (SELECT cohort, factor, level, COUNT(*) AS rows FROM sub GROUP BY ALL) SELECT cohort, factor, level, rows, CAST(row_number() OVER (ORDER BY CASE cohort WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, CASE level WHEN '65_plus' THEN 1 WHEN 'male' THEN 2 WHEN 'under_40' THEN 3 WHEN 'female' THEN 4 ELSE 5 END, level) AS INT) AS place FROM m""")
def k05(spark, sf_dir):
    """Cohorts and subgroups in orders of their own; what an order lacks comes last."""
    from pyspark.sql import Window as W

    counts = subgroups(spark, sf_dir).groupBy("cohort", "factor", "level").agg(F.count("*").alias("rows"))
    # A row a subgroup: as many as lists name.
    order = W.orderBy(L.rank_of(F.col("cohort"), ORDER["cohort"]), L.rank_of(F.col("level"), ORDER["level"]), "level")
    return counts.withColumn("place", F.row_number().over(order))


@query("r08_reliability_points", f"""WITH {BINS}, b AS (SELECT cohort, model, bin, SUM(n) AS n, SUM(sum_y) AS sum_y, SUM(sum_p) AS sum_p FROM binned GROUP BY ALL) SELECT cohort, model, bin, CAST(n AS BIGINT) AS count, round(round(sum_p, 9) / n, 6) AS mean_p, round(sum_y / CAST(n AS DOUBLE), 6) AS rate FROM b""")
def r08(spark, sf_dir):
    """The points of the reliability figure: all labels together, bins that have rows."""
    rows = C.reliability(predictions(spark, sf_dir), UNIT).where("label = 'pooled' and count > 0")
    return rounded(rows.select(*UNIT, "bin", "count", "mean_p", "rate"))


@query("r07_headline_shift", f"""WITH {BOOT_AUC}, {auc_sql("SELECT * FROM {PRED} WHERE label <> 'never'", "cohort, model, label", "a")}, pt AS (SELECT cohort, model, AVG(auroc) AS macro FROM a GROUP BY ALL), m AS (SELECT cohort, model, replicate, AVG(auroc) AS macro FROM boot GROUP BY ALL), b AS (SELECT cohort, model, quantile_cont(macro, 0.025) AS lower, quantile_cont(macro, 0.975) AS upper FROM m GROUP BY ALL)
SELECT cohort, model, round(pt.macro, 6) AS macro_auroc, round(lower, 6) AS lower, round(upper, 6) AS upper, round(pt.macro - MAX(pt.macro) FILTER (WHERE cohort = 'F') OVER (PARTITION BY model), 6) + 0 AS change FROM pt JOIN b USING (cohort, model)""")
def r07(spark, sf_dir):
    """The headline figure: every cohort's mean with its interval, and how far it is from the internal one."""
    points = D.macro(D.auroc(predictions(spark, sf_dir).where("label <> 'never'"), KEYS), UNIT, "auroc").select(*UNIT, "macro_auroc")
    bounds = B.interval(D.macro(boot(spark, sf_dir), [*UNIT, "replicate"], "auroc"), UNIT, "macro_auroc").select(*UNIT, "lower", "upper")
    inside = points.where("cohort = 'F'").select("model", F.col("macro_auroc").alias("inside"))
    rows = points.join(bounds, UNIT).join(inside, "model")
    return rounded(rows.select(*UNIT, "macro_auroc", "lower", "upper", (F.col("macro_auroc") - F.col("inside")).alias("change")))


MASS = f"""pr AS (SELECT * FROM {{PRED}}), e AS (SELECT cohort, model, label, list_distinct(quantile_cont(p, [{', '.join(f'CAST({k} AS DOUBLE) / 15' for k in range(1, 15))}])) AS edges FROM pr GROUP BY ALL),
 b AS (SELECT cohort, model, label, len(list_filter(edges, lambda x: x <= p)) AS bin, COUNT(*) AS n, SUM(y) AS sy, SUM(p) AS sp FROM pr JOIN e USING (cohort, model, label) GROUP BY ALL), mass AS (SELECT cohort, model, label, SUM(ABS(sy - sp)) / SUM(n) AS mass FROM b GROUP BY ALL)"""


@query("q24_mass_against_width", f"WITH {MASS}, {ece_sql('SELECT * FROM {PRED}', 'cohort, model, label', 'w')} SELECT cohort, model, round(AVG(w.ece), 6) AS width, round(AVG(mass), 6) AS mass, round(AVG(mass - w.ece), 6) + 0 AS change, round(MAX(ABS(mass - w.ece)), 6) AS most FROM mass JOIN w USING (cohort, model, label) GROUP BY ALL")
def q24(spark, sf_dir):
    """What the choice of bins does to the error: means over labels, their difference and the largest one."""
    rows = predictions(spark, sf_dir)
    both = C.calibration(rows, KEYS).select(*KEYS, F.col("ece").alias("w")).join(C.equal_mass_calibration(rows, KEYS).select(*KEYS, F.col("ece").alias("m")), KEYS)
    change = F.col("m") - F.col("w")
    return rounded(both.groupBy(*UNIT).agg(F.avg("w").alias("width"), F.avg("m").alias("mass"), F.avg(change).alias("change"), F.max(F.abs(change)).alias("most")))


METRICS = ("macro_auroc", "macro_ece", "pooled_ece", "brier")


@query("b03_full_pass", f"""WITH {BOOT_AUC}, ma AS (SELECT cohort, model, replicate, AVG(auroc) AS macro_auroc FROM boot GROUP BY ALL), t AS (SELECT cluster_id, cohort, model, label, LEAST(CAST(FLOOR(p * 15) AS INT), 14) AS bin, COUNT(*) AS n, SUM(y) AS sy, SUM(p) AS sp, SUM((p - y) * (p - y)) AS sq FROM {{PRED}} GROUP BY ALL),
 ws AS (SELECT cohort, model, label, replicate, bin, SUM(w * n) AS n, SUM(w * sy) AS sy, SUM(w * sp) AS sp, SUM(w * sq) AS sq FROM t JOIN w USING (cluster_id) GROUP BY ALL), le AS (SELECT cohort, model, replicate, label, SUM(ABS(sy - sp)) / nullif(SUM(n), 0) AS ece FROM ws GROUP BY ALL), me AS (SELECT cohort, model, replicate, AVG(ece) AS macro_ece FROM le GROUP BY ALL),
 pb AS (SELECT cohort, model, replicate, bin, SUM(n) AS n, SUM(sy) AS sy, SUM(sp) AS sp, SUM(sq) AS sq FROM ws GROUP BY ALL), pe AS (SELECT cohort, model, replicate, SUM(ABS(sy - sp)) / SUM(n) AS pooled_ece, SUM(sq) / SUM(n) AS brier FROM pb GROUP BY ALL), a AS (SELECT * FROM ma JOIN me USING (cohort, model, replicate) JOIN pe USING (cohort, model, replicate)),
 l AS ({" UNION ALL ".join(f"SELECT cohort, model, replicate, '{m}' AS metric, {m} AS v FROM a" for m in METRICS)}), d AS (SELECT x.cohort, x.metric, x.v - y.v AS change FROM l x JOIN l y ON x.cohort = y.cohort AND x.metric = y.metric AND x.replicate = y.replicate WHERE x.model = 'size' AND y.model = 'discount')
SELECT cohort, metric, round(quantile_cont(change, 0.025), 6) AS lower, round(quantile_cont(change, 0.975), 6) AS upper, COUNT(change) AS defined FROM d GROUP BY ALL""")
def b03_full(spark, sf_dir):
    """All four statistics of a cohort's pass by replicate, and what one model has over the other in each; bins are weighted once for both errors."""
    keys = [*UNIT, "replicate"]
    totals = C.bin_rows(predictions(spark, sf_dir), ["cluster_id", *KEYS])
    # Written once: both errors read them.
    sums = cut(B.replicate_sums(totals, [*KEYS, "bin"], ["n", "sum_y", "sum_p", "sum_sq"], REPLICATES))
    macro_ece = D.macro(C.from_totals(sums, [*KEYS, "replicate"]), keys, "ece").select(*keys, "macro_ece")
    pooled = C.from_totals(sums.groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in ("n", "sum_y", "sum_p", "sum_sq")]), keys).select(*keys, F.col("ece").alias("pooled_ece"), "brier")
    every = D.macro(boot(spark, sf_dir), keys, "auroc").select(*keys, "macro_auroc").join(macro_ece, keys).join(pooled, keys)
    long = every.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("m")).select(*keys, "m.*")
    change = B.contrast(long, ["cohort", "metric", "replicate"], "model", "size", "discount", "v")
    return rounded(B.interval(change, ["cohort", "metric"], "change").select("cohort", "metric", "lower", "upper", "defined"))


@query("b17_cell_seeds", f"""WITH c AS (SELECT DISTINCT ascii(cohort) * 10000 + k AS cell, cohort, k FROM {{ORDERS}} CROSS JOIN (SELECT unnest([100, 250, 500, 1000]) AS k)) SELECT cohort, CAST(k AS INT) AS k, CAST(r AS INT) AS repeat, {B.hash_draw_sql("cell + 2026", "r")} AS seed FROM c CROSS JOIN range(50) t(r)""")
def b17(spark, sf_dir):
    """A seed a cell (cohort and sample size) and repeat."""
    cells = orders(spark, sf_dir).select("cohort").distinct().withColumn("k", F.explode(F.array(*map(F.lit, (100, 250, 500, 1000)))))
    rows = cells.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(49))))
    return rows.select("cohort", "k", "repeat", B.cell_seed(F.ascii("cohort") * 10000 + F.col("k"), F.col("repeat"), 2026).alias("seed"))


@query("q03_store_audit", """WITH f AS (SELECT unnest(embedding) AS x FROM embeddings), a AS (SELECT (SELECT COUNT(*) FROM embeddings) AS records, COUNT(*) AS samples, COUNT(*) AS finite FROM f), c AS (SELECT label, COUNT(*) AS seen FROM embeddings GROUP BY label)
SELECT 'audit' AS section, 'records' AS name, records AS seen, records AS registered, true AS fits FROM a UNION ALL SELECT 'audit', 'finite', finite, samples, finite = samples FROM a
UNION ALL SELECT 'counts', 'label-' || label, seen, seen + CASE WHEN label = 0 THEN 1 ELSE 0 END, label <> 0 FROM c""")
def q03(spark, sf_dir):
    """A store's audit and its counts against registered ones (one of them off by one), in one table."""
    e = table(spark, sf_dir, "embeddings")
    found = signals.audit(lead_signals(spark, sf_dir), "vec_id")
    line = lambda name, seen, registered: F.struct(F.lit("audit").alias("section"), F.lit(name).alias("name"), seen.alias("seen"), registered.alias("registered"), (seen == registered).alias("fits"))
    ids = e.agg(F.countDistinct("vec_id").alias("ids"))
    audit = found.join(F.broadcast(ids), F.lit(True)).select(F.explode(F.array(line("records", F.col("records"), F.col("ids")), line("finite", F.col("finite"), F.col("samples")))).alias("l")).select("l.*")
    registered = e.groupBy(F.col("label").alias("value")).agg((F.count("*") + F.max((F.col("label") == 0).cast("long"))).alias("expected"))
    counts = E.value_counts(e, "label", registered)
    return audit.union(counts.select(F.lit("counts"), F.concat(F.lit("label-"), F.col("value").cast("string")), "seen", F.col("expected"), "fits"))


@query("i01_registration_guard", """WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT 'f' || k AS path, concat_ws('|', CASE WHEN k % 11 = 0 THEN 'file_there' END, CASE WHEN k % 13 = 0 THEN 'blob_there' END, CASE WHEN k % 11 = 0 OR k % 5 = 0 THEN 'file_as_sealed' END, CASE WHEN k % 13 = 0 OR k % 7 = 0 THEN 'blob_as_sealed' END,
 CASE WHEN k % 11 = 0 OR k % 13 = 0 OR k % 5 = 0 OR k % 7 = 0 THEN 'file_as_committed' END) AS broken FROM s""")
def i01(spark, sf_dir):
    """Registered files, seals and committed blobs with planted faults of every kind."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k, F.concat(F.lit("f"), k.cast("string")).alias("path"))
    found = s.where(k % 11 != 0).select("path", F.when(k % 5 == 0, sha("edited", k)).otherwise(sha(k)).alias("digest"))
    blobs = s.where(k % 13 != 0).select("path", F.when(k % 7 == 0, sha("other", k)).otherwise(sha(k)).alias("digest"))
    return P.registration_guard(s.select("path", sha(k).alias("digest")), found, blobs).select("path", F.array_join("broken", "|").alias("broken"))
